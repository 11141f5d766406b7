"""Spark-native retrieval and knowledge analytics."""
