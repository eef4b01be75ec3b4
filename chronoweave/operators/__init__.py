"""Interval, pooling, metric, attribution and audit operators: DataFrames in, DataFrames out."""
