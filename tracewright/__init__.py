"""Spark-native audit analytics over large text and code corpora."""
