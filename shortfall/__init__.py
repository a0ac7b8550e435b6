"""Supply-planning analytics on Spark DataFrames."""
