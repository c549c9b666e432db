"""Gristmill: corpus preparation on Spark, declared as DataFrame to DataFrame functions."""

__version__ = "0.1.0"
