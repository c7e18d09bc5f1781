"""keyhound: secret-detection analytics expressed as Spark DataFrame queries."""
