"""Document search and text statistics on Spark."""
