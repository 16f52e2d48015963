"""Operators for preparing text corpora, kept apart from the rest of the library."""
