"""Operators for large training-data corpora: deduplication, tokens, packing, quality, fixity, search, media, URLs."""
