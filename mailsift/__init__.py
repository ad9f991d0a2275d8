"""Message-abuse analytics as Spark DataFrame operators and streaming jobs."""
