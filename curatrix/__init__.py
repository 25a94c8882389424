"""Spark-first curation, sampling, scoring and evaluation of chat-style training data."""
