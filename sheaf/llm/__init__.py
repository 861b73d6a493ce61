"""Operators for large-scale training-data pipelines and their registered queries."""
