"""Column expressions and exact order statistics."""
