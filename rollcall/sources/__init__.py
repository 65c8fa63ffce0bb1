"""Where models come from and where they are written to."""
