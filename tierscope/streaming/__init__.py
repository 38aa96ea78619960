"""Streaming entry points (stateless batch scoring applied to a stream)."""
