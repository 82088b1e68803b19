"""Readers, writers and the adapter onto the test tables."""
