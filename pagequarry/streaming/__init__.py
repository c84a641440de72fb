"""Streaming forms of the fetch-log operators."""
