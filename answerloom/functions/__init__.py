"""Column expressions: text, predicates, JSON responses, vectors."""
