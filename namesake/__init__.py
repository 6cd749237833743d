"""Identity resolution for bibliographic records, built on Spark DataFrames."""
