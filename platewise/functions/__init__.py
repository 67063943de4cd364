"""Spark-native recipe and nutrition analytics."""
