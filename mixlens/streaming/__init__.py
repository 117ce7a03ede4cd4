"""Structured Streaming forms of the bridge."""
