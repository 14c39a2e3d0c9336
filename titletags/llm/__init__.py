"""Operators for training corpora, each a function from DataFrame to DataFrame."""
