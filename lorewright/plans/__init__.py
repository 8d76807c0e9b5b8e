"""Spark-native plans of the engine."""
