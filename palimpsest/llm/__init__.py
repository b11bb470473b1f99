"""Operators for large-scale training-data pipelines. Nothing else in the library imports this subpackage."""
