"""Study-program and research-position search on Spark DataFrames."""
