"""Column functions on the sphere and for photometry."""
