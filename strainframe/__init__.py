"""Sequence-surveillance analytics on Spark."""
