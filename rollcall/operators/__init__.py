"""Read and write operators. Reads give DataFrames, writes give a new Model and the rejects."""
