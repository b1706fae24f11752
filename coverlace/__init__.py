"""coverlace: topological analytics on Spark DataFrames."""
