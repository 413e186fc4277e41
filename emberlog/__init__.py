"""emberlog: log and event analytics as lazy Spark DataFrame operators."""
