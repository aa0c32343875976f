"""Security-graph analytics as PySpark DataFrame operators."""
