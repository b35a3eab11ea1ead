"""Spark-native analytics over named nodes, directed edges and ordered text lines."""
