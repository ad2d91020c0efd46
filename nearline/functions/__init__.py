"""Column-level helpers (text, hashing, vectors, token arrays)."""
