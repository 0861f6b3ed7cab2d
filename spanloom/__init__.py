"""Spark-native analytics for time-aligned text and interval data."""
