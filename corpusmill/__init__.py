"""Spark-native operators for building, searching and curating text corpora."""
