"""Column expressions: text, urls, graph lines."""
