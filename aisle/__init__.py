"""Product-catalogue preparation, search and ranking as Spark DataFrame jobs."""
