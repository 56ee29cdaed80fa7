"""Column functions: text, arrays, hashes."""
