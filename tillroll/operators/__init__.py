"""Operators: every one takes DataFrames and parameters and returns a DataFrame."""
