"""Spark-native ranking, offline evaluation and corpus preparation."""
