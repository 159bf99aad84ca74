"""Structured Streaming versions of the round barrier and of running moments."""
