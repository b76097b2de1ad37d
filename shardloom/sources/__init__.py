"""Readers, writers and the derived views that feed the operators."""
