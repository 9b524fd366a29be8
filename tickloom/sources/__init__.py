"""Readers and record-level validation."""
