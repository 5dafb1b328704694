"""Spark-native operators for comparing groups across topics and time."""
