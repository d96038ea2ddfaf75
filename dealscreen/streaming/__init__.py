"""Structured Streaming entry points (bronze file stream)."""
