"""Operators of a training-data pipeline: deduplication, filters, extraction and mixing."""
