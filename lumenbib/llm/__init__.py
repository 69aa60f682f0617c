"""Operators for training-data pipelines: scoring, near duplicates, packing, tokens, licences, archives.

Nothing else in the library imports this subpackage; its queries are in ``lumenbib.llm.queries``.
"""
