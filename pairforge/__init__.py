"""Spark jobs that turn documents into fine-tuning datasets."""
