"""lexmill: corpus preparation and evaluation analytics on Spark DataFrames."""
