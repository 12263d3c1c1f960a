"""Structured Streaming forms of the corpus operators."""
