"""Detectors, scoring and result queries, each a function from DataFrames to DataFrames."""
