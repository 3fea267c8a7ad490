"""Column functions on terms and names."""
