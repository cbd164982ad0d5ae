"""sediment: a Spark-first engine for point-in-time event data."""
