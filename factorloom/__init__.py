"""Factor research on Spark DataFrames."""
