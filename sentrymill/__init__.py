"""Security-alert analytics as Spark DataFrame operators."""
