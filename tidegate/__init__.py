"""Panel analytics and signal validation as Spark DataFrame operators."""
