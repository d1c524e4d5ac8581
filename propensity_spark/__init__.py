"""Customer propensity analytics on Spark DataFrames."""
