"""tidemark: turning-point analytics for pooled bar series, on Spark DataFrames."""
