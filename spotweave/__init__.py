"""Spark-native analytics for molecule-resolution spatial data."""
