"""Batch passage search, label mining and retrieval measurement on Spark DataFrames."""

__version__ = "0.1.0"
