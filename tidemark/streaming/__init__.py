"""Structured Streaming versions of the event jobs."""
