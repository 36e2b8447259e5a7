"""Operators for preparing training data: near-duplicates, secrets, PII, mixing, packing, scoring, search."""
