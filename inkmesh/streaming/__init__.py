"""Streaming analogues of the interactive behaviour."""
