"""Structured Streaming form of the scan."""
