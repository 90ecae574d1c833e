"""Document de-identification analytics expressed as Spark DataFrame jobs."""
