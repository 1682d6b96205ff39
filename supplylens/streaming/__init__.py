"""Extras on the events table: the same functions serve batch frames and streams."""
