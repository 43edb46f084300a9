"""Operators for training-data pipelines, their queries and their SQL."""
