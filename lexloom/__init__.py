"""Lexloom: retrieval, corpus processing and ranking evaluation on Spark DataFrames."""

__version__ = "0.1.0"
