"""Operators for preparing training text: dedup, filters, languages, mixing, tokens."""
