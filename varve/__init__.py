"""varve: feature association and prioritisation on Spark DataFrames."""
