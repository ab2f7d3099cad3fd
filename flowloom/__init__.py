"""Analytics over directed flows of value, written as Spark DataFrame work."""

__version__ = "0.1.0"
