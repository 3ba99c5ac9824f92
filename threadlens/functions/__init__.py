"""Column expressions: no shuffle, no Python workers."""
