"""Set-based evidence, provenance and time-travel analytics on Spark DataFrames."""
