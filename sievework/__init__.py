"""Spark-native retrieval analytics engine."""
