"""Retail and supply analytics on Spark."""
