"""Interval and evaluation analytics for PySpark."""
