"""Column functions on vectors, ranks and text."""
