"""Operators for large text corpora: tokens, near duplicates, licences, vectors, quality, personal data, mixing, archives."""
