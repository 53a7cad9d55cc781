"""Retail transaction analytics as PySpark DataFrame operators."""
