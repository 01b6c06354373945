"""Analytics over data-pipeline tables as Spark jobs."""
