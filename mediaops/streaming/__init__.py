"""Structured Streaming forms: watching a library, following job state."""
