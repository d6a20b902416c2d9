"""Structured Streaming twins of the online operators."""
