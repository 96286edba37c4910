"""Grid-fault sequence analytics as plain PySpark DataFrame jobs."""
