"""lectern: corpus analytics on Spark DataFrames."""
