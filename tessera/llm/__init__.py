"""Operators for preparing training text: thirteen whole-table jobs over documents, pages,
conversations and embeddings.

Every module exposes one general operator plus the thin query that registers it.
"""
