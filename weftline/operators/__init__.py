"""Operators on corpora: filters, steps, preprocessors, models."""
