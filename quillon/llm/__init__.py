"""Operators of a training-data pipeline: tokenising, deduplication, filtering and mixing of text."""
