"""Readers, writers, layouts and the graphs built from relational tables."""
