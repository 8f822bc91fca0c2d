"""Spark-native analytics for text corpora and agent-session logs."""
