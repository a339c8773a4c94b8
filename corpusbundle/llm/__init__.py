"""Operators for training data: deduplication, filters, formatting, packing and scoring."""
