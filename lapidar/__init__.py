"""Spark-native analytics over annotated multilingual text corpora."""
