"""Column functions: text analysis, tagging, vectors, URLs."""
