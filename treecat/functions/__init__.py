"""Column functions, and the plain functions they go with."""
