"""Analytics over engineering-quality and traceability data, as Spark DataFrame jobs."""
