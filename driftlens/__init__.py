"""Spark-native analytics over a data project's own metadata and over its tables."""

__version__ = "0.1.0"
