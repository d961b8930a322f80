"""Column functions: filters, text, analysis, vectors, chunking and highlighting."""
