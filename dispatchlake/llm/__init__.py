"""Operators for preparing training text: fingerprints, deduplication, filters and mixing."""
