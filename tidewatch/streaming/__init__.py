"""Structured Streaming over the same column code as the batch operators."""
