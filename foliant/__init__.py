"""Spark-native analytics over page-structured document corpora."""

__version__ = "0.1.0"
