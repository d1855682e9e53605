"""Structured Streaming use of the linkage operators."""
