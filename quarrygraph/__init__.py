"""Spark-native analytics over code-knowledge-graph tables."""
