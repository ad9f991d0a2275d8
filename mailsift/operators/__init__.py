"""DataFrame operators: every function takes DataFrames and parameters and returns a DataFrame."""
