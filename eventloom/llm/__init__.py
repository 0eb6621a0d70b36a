"""Operators for preparing training data: search, mixing, deduplication, tokens, archives, filters.

Nothing outside this subpackage imports it. ``queries`` holds the thin registered queries.
"""
