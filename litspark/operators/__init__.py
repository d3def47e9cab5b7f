"""Relational operators of the library engine."""
