"""Exact, index-accelerated text search and trace analytics on Spark DataFrames."""
