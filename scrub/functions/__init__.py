"""Column functions: text, masks and keyed hashes."""
