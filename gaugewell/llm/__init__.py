"""Operators on training data: percentiles, distinct counts, frequent items, tokens, leaks and splitting.

Nothing outside this subpackage imports it.
"""
