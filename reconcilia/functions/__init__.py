"""Column expressions for text, money, dates and movement concepts."""
