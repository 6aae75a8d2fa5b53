"""Row-local expressions, as Spark SQL text."""
