"""Spark-native analytics for daily market data."""
