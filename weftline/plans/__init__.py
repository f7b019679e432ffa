"""Pipelines of filters, and the runner of described steps."""
