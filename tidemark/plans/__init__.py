"""Composed plans: the governed query and the full rebuild."""
