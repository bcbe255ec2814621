"""Spark-native stages for building, filtering and scoring code data sets."""

__version__ = "0.1.0"
