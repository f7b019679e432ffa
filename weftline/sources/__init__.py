"""Readers and writers of line-aligned text, scores and values."""
