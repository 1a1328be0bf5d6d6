"""Table-level jobs: every function maps DataFrames to a DataFrame."""
