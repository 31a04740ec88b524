"""Sievework: governed text analytics and training-data preparation on Spark DataFrames."""

__version__ = "0.1.0"
