"""Operators of a training-data pipeline: scoring, search, duplicates, packing, tokens, filters, archives."""
