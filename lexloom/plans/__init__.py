"""plans of lexloom."""
