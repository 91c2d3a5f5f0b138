"""Operators of a training-data pipeline: scoring, scanning, packing, deduplication, tokenizing, extraction."""
