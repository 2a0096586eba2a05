"""Structured Streaming forms of the fold."""
