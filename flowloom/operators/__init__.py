"""Operators: every one takes DataFrames and returns a DataFrame."""
