"""Data discovery and cohort analytics as Spark DataFrame operators."""
