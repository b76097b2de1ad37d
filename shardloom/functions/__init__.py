"""Column expressions: hashing, checks, display text, binary fields."""
