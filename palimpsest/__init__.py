"""palimpsest: document-originality analytics on Spark DataFrames."""
