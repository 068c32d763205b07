"""Event-intelligence analytics on Spark DataFrames."""
