"""Interval analytics on Spark: DataFrame operators for interval-shaped data."""

__version__ = "0.1.0"
