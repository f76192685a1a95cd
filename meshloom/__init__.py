"""Search, web analytics and corpus processing over a mesh of small sites, planned as Spark DataFrames."""

__version__ = "0.1.0"
