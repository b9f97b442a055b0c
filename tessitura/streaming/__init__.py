"""Structured Streaming variants of the note operators."""
