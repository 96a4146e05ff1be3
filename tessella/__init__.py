"""Ranked retrieval, experiment analytics and training-data operators on Spark."""
