"""A Spark-native analytics engine for order-driven businesses."""

__version__ = "0.1.0"
