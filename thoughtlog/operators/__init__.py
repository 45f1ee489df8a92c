"""Operators over entry, token, window and label tables."""
