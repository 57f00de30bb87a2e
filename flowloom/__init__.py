"""flowloom: execution-flow graphs and training-data operators as Spark jobs."""
