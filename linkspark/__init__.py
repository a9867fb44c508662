"""linkspark: record linkage, name matching and registry maintenance on Spark DataFrames."""

__version__ = "0.1.0"
