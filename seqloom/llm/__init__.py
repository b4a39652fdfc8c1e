"""Operators for building training collections; nothing else in the library imports this package."""
