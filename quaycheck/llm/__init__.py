"""Operators for preparing training data: scoring, packing, identification, deduplication, archives and extraction."""
