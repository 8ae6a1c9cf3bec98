"""Column functions and hashes."""
