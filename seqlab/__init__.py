"""Per-entity sequence analytics on Spark DataFrames."""
