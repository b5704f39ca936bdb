"""Lattica: a Spark-native knowledge-graph and corpus analytics engine."""

__version__ = "0.1.0"
