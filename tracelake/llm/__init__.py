"""Operators for preparing training text: mixing, deduplication, extraction, archives, scoring and search."""
