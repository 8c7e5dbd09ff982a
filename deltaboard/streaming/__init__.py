"""Structured Streaming wrappers around the plans."""
