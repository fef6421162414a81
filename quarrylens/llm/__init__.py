"""Operators of a training-data pipeline: mixing, near-duplicates, tokens, pages, search, archives, languages."""
