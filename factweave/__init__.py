"""factweave: code-fact analytics on Spark DataFrames."""
