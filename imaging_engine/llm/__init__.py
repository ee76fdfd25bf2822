"""Operators for text corpora and training data. Nothing outside this package imports it."""
