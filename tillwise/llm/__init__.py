"""Operators of a large-scale training-data pipeline, written for Spark."""
