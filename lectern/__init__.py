"""Lectern: catalog search and recommendation as set-based Spark jobs."""

__version__ = "0.1.0"
