"""Operators for preparing training text: scoring, packing, near duplicates, filters."""
