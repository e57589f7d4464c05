"""Operators for preparing training corpora from page texts. Nothing else in the library imports this package."""
