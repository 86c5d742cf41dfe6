"""Spark-native engine for text corpora and hybrid retrieval."""
