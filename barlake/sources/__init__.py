"""Readers, writers, reference dimensions and the bindings to the sample tables."""
