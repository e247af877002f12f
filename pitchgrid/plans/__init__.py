"""Composed queries and their SQL equivalents."""
