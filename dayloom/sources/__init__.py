"""Readers, writers and path resolution."""
