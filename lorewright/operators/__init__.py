"""Spark-native operators of the engine."""
