"""Whole pipelines and the named query catalogue."""
