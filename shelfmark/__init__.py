"""Portfolio bookkeeping and corpus preparation as Spark jobs."""
