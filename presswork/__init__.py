"""Spark-native analytics for news-style records."""
