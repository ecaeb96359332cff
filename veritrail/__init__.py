"""Response verification and corpus preparation as Spark DataFrame jobs."""
