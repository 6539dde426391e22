"""Operators of a training-data pipeline: quality, encoding, deduplication, filters, packing, search."""
