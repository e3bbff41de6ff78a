"""Structured Streaming forms of the engine's time-bounded operators."""
