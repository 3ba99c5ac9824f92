"""Readers, writers and configuration tables."""
