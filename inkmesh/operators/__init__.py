"""Operators over the note and link tables."""
