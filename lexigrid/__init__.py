"""lexigrid: approximate dictionary search and its analytics on Spark DataFrames."""
