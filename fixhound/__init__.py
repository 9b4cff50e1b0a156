"""Vulnerability-fix reporting and similar-code search as Spark jobs."""

__version__ = "0.1.0"
