"""River-network analytics as Spark DataFrame operators."""
