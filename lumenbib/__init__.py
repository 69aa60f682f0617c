"""Bibliographic entity resolution and relevance scoring as Spark DataFrame operators."""

__version__ = "0.1.0"
