"""Analytics over project-case records, written as Spark DataFrame and SQL jobs."""
