"""Structured Streaming forms of the sequence operators."""
