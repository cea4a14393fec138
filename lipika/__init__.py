"""Spark-native analytics over text-recognition evaluation data."""
