"""Single-cell count analytics on Spark DataFrames."""
