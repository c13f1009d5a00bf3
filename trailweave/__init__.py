"""Clustering of event-log activities with Spark DataFrames."""

__version__ = "0.1.0"
