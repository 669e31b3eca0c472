"""streaming of lexloom."""
