"""Column-level functions; all built on pyspark.sql.functions."""
