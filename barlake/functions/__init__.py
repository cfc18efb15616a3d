"""Column functions: no shuffle, no Python per row."""
