"""Customer-value analytics as PySpark DataFrame functions."""

from custvalue.rules import Rules

__all__ = ["Rules"]
