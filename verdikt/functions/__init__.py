"""Column expressions and fixed rule values."""
