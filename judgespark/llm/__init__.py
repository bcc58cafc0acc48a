"""Operators of a training-data pipeline: search, deduplication, scoring, secrets, packing, mixing."""
