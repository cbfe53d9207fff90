"""Sequence-to-matrix analytics on Spark."""
