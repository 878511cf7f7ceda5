"""Web-embedding graph analytics, expressed as Spark DataFrame operators."""
