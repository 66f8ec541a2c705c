"""Spark-native retrieval, curation and governance analytics over large collections of short texts."""
