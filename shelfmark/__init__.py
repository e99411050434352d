"""shelfmark: document-retrieval analytics on Spark DataFrames."""
