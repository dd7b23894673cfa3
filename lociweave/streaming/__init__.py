"""Structured Streaming forms of the joins against a fixed database."""
