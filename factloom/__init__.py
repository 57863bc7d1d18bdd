"""Spark-native corpus building, retrieval and answer evaluation."""

__version__ = "0.1.0"
