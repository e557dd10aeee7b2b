"""Retail customer analytics on Spark."""
