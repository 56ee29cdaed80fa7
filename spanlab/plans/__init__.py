"""Derived views that several queries share."""
