"""Host-evidence analytics on Spark DataFrames."""
