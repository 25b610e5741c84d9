"""Structured Streaming over prediction files; an extension of the batch evaluation."""
