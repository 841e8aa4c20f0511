"""Structured Streaming versions of the live reports."""
