"""plantlens: manufacturing-quality analytics as Spark DataFrame jobs."""
