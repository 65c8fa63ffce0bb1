"""Column-level helpers: plain functions from Column to Column."""
