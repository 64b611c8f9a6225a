"""Structured Streaming plans and the state they keep."""
