"""Operators for preparing language-model training data. One module per operator."""
