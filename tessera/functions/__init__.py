"""Column functions on texts, vectors, media and numbers."""
