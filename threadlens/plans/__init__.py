"""Whole pipelines composed of operators."""
