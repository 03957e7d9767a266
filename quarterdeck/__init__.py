"""Investment-record and holdings analytics as plain Spark DataFrame jobs."""
