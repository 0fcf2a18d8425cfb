"""A market-data and strategy-analytics engine on Spark DataFrames."""
