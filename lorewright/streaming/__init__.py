"""Spark-native streaming of the engine."""
