"""Operators for preparing training corpora: deduplication, filters, mixing, tokens, formats.

Nothing outside this subpackage imports it.
"""
