"""Structured Streaming forms of operators whose input keeps coming."""
