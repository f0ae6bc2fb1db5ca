"""Tidemark: a Spark-native engine for classifying streams of feed items under concept drift."""
