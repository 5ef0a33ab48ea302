"""Readers: transcripts, and the facade over the given tables."""
