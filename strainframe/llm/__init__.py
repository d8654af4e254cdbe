"""Operators for preparing training text: encoding, mixing, scoring, extraction, deduplication and privacy."""
