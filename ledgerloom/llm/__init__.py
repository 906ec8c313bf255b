"""Operators for preparing training text: dedup, filters, tokens, mixing, packing."""
