"""Entity rating, comparison and search as Spark DataFrame operators."""
