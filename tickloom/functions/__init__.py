"""Column-expression builders: scalars, windows, statistics."""
