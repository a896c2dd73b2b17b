"""Web-page audit analytics on Spark DataFrames."""
