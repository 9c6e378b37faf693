"""Operators for preparing training text: quality, dedup, mixing, tokens, language-model scores, media and PII.

Nothing else in the library imports this subpackage. Every operator takes DataFrames and returns DataFrames;
``queries`` in :mod:`tidemark.llm.registry` binds them to whole tables.
"""
