"""Operators for preparing large text corpora, each a function from DataFrames to a DataFrame."""
