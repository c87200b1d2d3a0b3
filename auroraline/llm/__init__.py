"""Operators for large text corpora: scoring, deduplication, filtering and tokens.

Nothing else in the library imports this subpackage.
"""
