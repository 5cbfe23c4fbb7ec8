"""Spark-native analytics over long documents, fundamentals and event streams."""
