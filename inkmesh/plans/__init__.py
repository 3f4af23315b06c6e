"""Composed plans: the query catalogue and the ingest pipeline."""
