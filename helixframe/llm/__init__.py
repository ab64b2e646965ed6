"""Operators for large-scale training-data pipelines."""
