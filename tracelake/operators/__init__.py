"""Analyses: each function takes DataFrames and keyword arguments, returns a DataFrame."""
