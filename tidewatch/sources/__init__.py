"""Readers, writers and views of the source tables."""
