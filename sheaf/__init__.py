"""sheaf: document evidence and data quality on Spark DataFrames."""
