"""Tessera: a Spark-native engine for message analytics and corpus preparation."""

__version__ = "0.1.0"
