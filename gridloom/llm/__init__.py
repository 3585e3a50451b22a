"""Operators for training corpora: deduplication, packing, quality, search, language-model scores and tokenizing.

Nothing else in the library imports this package; its queries are in `gridloom.llm.queries`.
"""
