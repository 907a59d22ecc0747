"""Readers and writers: document sources, persisted index, judgments and run files."""
