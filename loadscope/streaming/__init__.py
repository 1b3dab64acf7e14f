"""Structured Streaming forms of the time-binned and per-request metrics."""
