"""Multi-model analytics on Spark DataFrames."""
