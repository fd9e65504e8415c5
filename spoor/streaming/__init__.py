"""Structured Streaming: keyed state over event streams."""
