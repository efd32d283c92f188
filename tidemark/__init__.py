"""Longitudinal feature analytics as Spark DataFrame operators."""
