"""Operators of a training-data pipeline: deduplication, filtering, encoding and packing of documents."""
