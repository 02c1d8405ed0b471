"""Operators for large training-data pipelines, each with its own query."""
