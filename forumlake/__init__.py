"""Set-based forum analytics on Spark DataFrames."""
