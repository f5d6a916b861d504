"""Domain plans: each function takes DataFrames and returns a DataFrame."""
