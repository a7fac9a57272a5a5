"""Operators of a training-data pipeline: deduplication, filters, archives, mixing and packing."""
