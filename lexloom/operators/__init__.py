"""Distributed operators: index building, scoring, vectors, evaluation, and scan and join helpers."""
