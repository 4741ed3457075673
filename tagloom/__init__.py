"""Spark-native analytics engine for tagged media libraries."""
