"""Spark-native functions of the engine."""
