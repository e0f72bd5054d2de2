"""Spark-native demand analytics on day-grain and hour-grain tables."""
