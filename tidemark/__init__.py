"""Change-data analytics on Spark: declarative operators for batch and Structured Streaming."""
