"""Column functions: null-safe arithmetic, parsing, text rules."""
