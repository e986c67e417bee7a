"""Fleet-scale flight-log analytics on Spark DataFrames."""
