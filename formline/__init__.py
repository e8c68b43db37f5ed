"""formline: leakage-safe form, line and outcome analytics on Spark DataFrames."""
