"""Customer-feedback signals and drift monitoring on Spark DataFrames."""
