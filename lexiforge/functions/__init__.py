"""Column functions: text, vectors, predicates."""
