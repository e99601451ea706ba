"""Column expressions: text cleaning, numbers, statistics."""
