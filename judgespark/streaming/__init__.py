"""Structured Streaming versions of the live run views."""
