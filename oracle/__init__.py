"""SQL the Spark queries are checked against."""
