"""Spark-native data quality and dependency mining."""
