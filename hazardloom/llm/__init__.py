"""Operators for training-data preparation: each is a function from DataFrames to DataFrames."""
