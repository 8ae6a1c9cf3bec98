"""Time-ordered segment archives, and corpus preparation, on Spark DataFrames."""
