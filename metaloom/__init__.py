"""Spark-native analytics over code, metadata and text corpora."""
