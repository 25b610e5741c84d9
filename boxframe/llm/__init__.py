"""Operators for training-data pipelines over web text, pages and vectors.

Nothing outside this folder imports it.
"""
