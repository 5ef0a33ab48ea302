"""Column builders and fixed tables."""
