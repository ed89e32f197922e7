"""Composite search, repository map and indexing plans."""
