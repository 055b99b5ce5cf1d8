"""Readers, writers and the surrogate views over the given tables."""
