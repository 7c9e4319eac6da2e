"""Spark-native provenance, leakage-audit and grouped-evaluation analytics."""

__version__ = "0.1.0"
