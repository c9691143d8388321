"""Vector analytics on Spark DataFrames: exact and approximate nearest neighbours, quotas, filters, training, merging."""
