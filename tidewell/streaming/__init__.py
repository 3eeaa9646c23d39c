"""Batches that arrive as streams."""
