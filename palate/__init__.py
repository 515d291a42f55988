"""Personal-taste analytics expressed as Spark DataFrame jobs."""
