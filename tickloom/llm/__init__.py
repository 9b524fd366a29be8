"""Operators for text corpora and record matching; nothing outside this package imports it."""
