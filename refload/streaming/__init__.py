"""Structured Streaming forms of the file watch and of the load."""
