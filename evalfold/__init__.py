"""evalfold: evaluation analytics over planned trials, expressed as Spark DataFrame jobs."""
