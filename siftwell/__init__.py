"""Spark-native text-corpus quality engine."""

__version__ = "0.1.0"
