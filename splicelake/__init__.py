"""Splice-site usage analytics on Spark DataFrames."""
