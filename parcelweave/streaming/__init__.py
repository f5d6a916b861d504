"""Structured Streaming forms of the incremental counts."""
