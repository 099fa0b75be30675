"""Operators for preparing language-model training data (ten operators and a pipeline)."""
