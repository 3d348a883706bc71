"""Structured Streaming forms of the run-event operators."""
