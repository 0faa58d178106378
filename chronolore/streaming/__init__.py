"""Structured Streaming forms of the temporal operators."""
