"""Structured Streaming versions of the indicators."""
