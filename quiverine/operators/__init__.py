"""Operators over collections: DataFrames of (id, vector, metadata).

A row without a vector is metadata whose vector was never stored or was removed; a row
without metadata has none. Both are legal.
"""
