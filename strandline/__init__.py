"""Spark-native analytics over evidence traces, program graphs and corpora."""

__version__ = "0.1.0"
