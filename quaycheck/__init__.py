"""Quality gate for landed data files, expressed as Spark DataFrame jobs."""
