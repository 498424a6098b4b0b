"""Column and plain Python functions."""
