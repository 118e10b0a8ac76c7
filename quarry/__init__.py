"""Spark-native token-positional text search and corpus analytics."""
