"""verdikt: head-to-head contest analytics as Spark DataFrame jobs."""
