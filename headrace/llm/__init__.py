"""Operators for building training text: scoring, duplicates, licences, archives, tokens, extraction."""
