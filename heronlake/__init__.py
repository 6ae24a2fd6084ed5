"""heronlake: a Spark-first engine for document collections."""
