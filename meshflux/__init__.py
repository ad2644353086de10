"""Weighted-network and evidence analytics as PySpark DataFrame jobs."""
