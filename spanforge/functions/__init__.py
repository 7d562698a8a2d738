"""Column functions on texts, spans and scores; all built-in expressions, no UDF."""
