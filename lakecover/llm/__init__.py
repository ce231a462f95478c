"""Operators for large training-text pipelines; nothing outside this package imports it."""
