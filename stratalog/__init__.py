"""Spark-native analytics for timed text, note collections and document corpora."""

__version__ = "0.1.0"
