"""Operators from DataFrames to DataFrames; columns are parameters."""
