"""Operators of a training-data pipeline: deduplication, filters, tokens, packing, search.

Nothing else in the library imports this package.
"""
