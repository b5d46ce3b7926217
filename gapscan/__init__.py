"""gapscan: Spark-native analytics for code-coverage and test-quality tables."""
