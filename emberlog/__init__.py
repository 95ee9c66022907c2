"""emberlog: log-capture analytics as Spark DataFrame operators."""
