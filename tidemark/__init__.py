"""tidemark: point-in-time event studies and temporal data processing on Spark DataFrames."""

__version__ = "0.1.0"
