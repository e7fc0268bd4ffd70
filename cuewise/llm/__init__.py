"""Operators for large text corpora and vector tables."""
