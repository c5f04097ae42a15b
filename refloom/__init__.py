"""Citation-audit analytics over whole corpora of papers, on Spark DataFrames."""
