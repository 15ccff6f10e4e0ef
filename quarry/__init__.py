"""Spark-native code-graph analytics, search, curation and evaluation."""
