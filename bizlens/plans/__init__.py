"""The analytical functions: each takes DataFrames and returns a DataFrame."""
