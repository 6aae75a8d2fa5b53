"""Structured Streaming over the same plans."""
