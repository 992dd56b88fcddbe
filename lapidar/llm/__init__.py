"""Operators on training texts. Nothing outside this folder imports from here."""
