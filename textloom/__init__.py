"""textloom: source-text analytics on Spark DataFrames."""
