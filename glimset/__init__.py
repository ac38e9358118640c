"""Glimset: photo-set analytics on Spark."""
