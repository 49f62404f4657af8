"""Column functions: text and URLs."""
