"""Incremental builds on Structured Streaming."""
