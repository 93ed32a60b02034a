"""Column functions beyond the built-in library."""
