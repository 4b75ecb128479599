"""Spark-native analytics on panels of periodic values."""
