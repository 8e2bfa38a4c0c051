"""Fleet telemetry history and incident analytics as Spark DataFrame jobs."""
