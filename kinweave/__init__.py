"""kinweave: entity resolution and profile analytics on Spark DataFrames."""

__version__ = "0.1.0"
