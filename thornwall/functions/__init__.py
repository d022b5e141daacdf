"""Column functions on texts."""
