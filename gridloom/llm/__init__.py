"""Operators for text corpora. Nothing outside this package imports it."""
