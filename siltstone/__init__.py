"""Spark-native retrieval analytics: lexical, vector and signature search, evaluation and ingestion as DataFrame plans."""
