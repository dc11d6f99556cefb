"""Column expressions for text, units, colours and geometry."""
