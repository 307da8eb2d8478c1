"""Protocol-document analytics on Spark DataFrames."""
