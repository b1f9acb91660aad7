"""Statistical-genomics analytics on Spark DataFrames."""
