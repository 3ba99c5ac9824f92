"""Structured Streaming forms of the collection operators."""
