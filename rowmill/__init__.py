"""rowmill: SQL analytics over pipe-delimited and Parquet tables, expressed in Spark DataFrames and SQL."""
