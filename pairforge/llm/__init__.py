"""Operators for training-data pipelines: deduplication, scoring, mixing, formatting and token output."""
