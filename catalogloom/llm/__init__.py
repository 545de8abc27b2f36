"""Operators for preparing training text: duplicates, filters, tokens, packing and search."""
