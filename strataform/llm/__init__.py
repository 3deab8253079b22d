"""Operators for preparing large text corpora (not used by the rest of the library)."""
