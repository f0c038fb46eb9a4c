"""Composed perception pipelines."""
