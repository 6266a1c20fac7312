"""Operators that prepare code and text collections for language-model training."""
