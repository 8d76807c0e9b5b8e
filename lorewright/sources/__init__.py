"""Spark-native sources of the engine."""
