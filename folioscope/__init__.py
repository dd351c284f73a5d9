"""A document-retrieval and corpus engine on Spark DataFrames."""
