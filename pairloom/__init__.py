"""pairloom: blocking, entity matching and retrieval evaluation on Spark DataFrames."""

__version__ = "0.1.0"
