"""recordrank: record matching, scoring and ranking on Spark DataFrames."""
