"""Operators for large training-data pipelines; nothing outside this folder imports it."""
