"""Analytics for field-visit programmes as lazy Spark DataFrames."""
