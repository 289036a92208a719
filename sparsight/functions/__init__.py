"""Column expressions and small vector helpers."""
