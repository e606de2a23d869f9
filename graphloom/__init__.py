"""graphloom: retrieval-graph analytics on Spark DataFrames."""
