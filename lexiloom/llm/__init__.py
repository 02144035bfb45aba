"""Operators for large text corpora used as training data."""
