"""Spark-native loss-reserving analytics: triangles, reserving methods, backtests."""

__version__ = "0.1.0"
