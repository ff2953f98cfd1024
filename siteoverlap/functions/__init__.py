"""Column functions and the one numeric helper."""
