"""Graph-pattern queries and corpus analytics on Spark DataFrames."""
