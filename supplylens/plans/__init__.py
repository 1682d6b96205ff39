"""Guarded SQL and the tool registry."""
