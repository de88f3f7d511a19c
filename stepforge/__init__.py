"""Step-wise analytics on Spark DataFrames."""
