"""Operators of a training-data pipeline over a corpus of documents.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own interface; ``queries`` holds the thin registered queries.
"""
