"""A document index and retrieval engine on Spark DataFrames."""
