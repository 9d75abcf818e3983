"""barloom: time-series market research as Spark DataFrame jobs."""
