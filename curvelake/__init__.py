"""Time-resolved network curvature analytics on Spark DataFrames."""
