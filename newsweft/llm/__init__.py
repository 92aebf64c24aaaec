"""Operators of a training-data pipeline: quality, deduplication, decontamination, storage and packing."""
