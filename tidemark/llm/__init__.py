"""Operators that prepare text, pages and embeddings for training language models.

Nothing outside this subpackage imports it. ``registry.queries()`` and ``registry.oracle_sql()`` hold its queries.
"""
