"""Column expressions over text, sets and vectors."""
