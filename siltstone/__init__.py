"""Spark-native analytics for retrieval pipelines and training text."""
