"""Spark-native analytics for layered spatial scenes."""
