"""Operators for training-data pipelines over a ``documents`` table. Nothing outside imports this package."""
