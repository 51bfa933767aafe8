"""Composite pipelines: scan, drift, locale sync, translation, suggestions, improvement, checks."""
