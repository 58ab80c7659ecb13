"""facetspark: analytics over image libraries and their metadata, on Spark DataFrames."""
