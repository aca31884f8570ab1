"""Operators for text and vector training data; nothing else in the library imports this package."""
