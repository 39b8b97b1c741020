"""Spark jobs for very large photo libraries."""

__version__ = "0.1.0"
