"""Heat-kernel manifold learning on Spark DataFrames."""
