"""Column expressions: label dictionary, text and array helpers."""
