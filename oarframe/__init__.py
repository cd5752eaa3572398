"""oarframe: regatta analytics and data preparation as plain Spark DataFrame jobs."""
