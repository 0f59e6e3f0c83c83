"""Operators of the language-model data line; nothing else in the library imports this package."""
