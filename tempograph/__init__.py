"""tempograph: a Spark-first bi-temporal knowledge-graph memory engine."""
