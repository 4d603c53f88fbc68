"""Operators that prepare training data, each a function from DataFrames to a DataFrame."""
