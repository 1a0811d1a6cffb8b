"""Corpus-to-training-data and evaluation analytics on Spark."""
