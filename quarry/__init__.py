"""Spark-native analytics over source-code repositories and over tables shaped like them."""

__version__ = "0.1.0"
