"""Operators for building training corpora: scoring, archives, extraction, deduplication, packing, mixing.

Nothing else in the package imports this one.
"""
