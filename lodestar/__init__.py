"""lodestar: Spark-native vector search and analytics."""

__version__ = "0.1.0"
