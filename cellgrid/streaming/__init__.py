"""Cell objects from streams."""
