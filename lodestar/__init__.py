"""Code-intelligence graph analytics on Spark DataFrames."""
