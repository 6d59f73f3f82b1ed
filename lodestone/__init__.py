"""Spark-native engine for messy business content, call transcripts and training data."""
