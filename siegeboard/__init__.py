"""Co-op match analytics written as Spark DataFrame jobs."""
