"""Spark-native analytics over date x instrument panels."""
