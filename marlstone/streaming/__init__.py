"""Structured Streaming over the event log."""
