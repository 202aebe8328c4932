"""Column functions and request checks."""
