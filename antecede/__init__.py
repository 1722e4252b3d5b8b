"""Strictly-causal risk analytics over event tables, on Spark DataFrames."""

__version__ = "0.1.0"
