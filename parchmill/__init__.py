"""Structured scholarly documents and training-data operators on Spark."""
