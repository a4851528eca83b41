"""Operators for the text of large training corpora; nothing else in the package imports this."""
