"""Readers that turn trees, specifications and locks into DataFrames."""
