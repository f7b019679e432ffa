"""Errors that users of the library see."""


class ConfigurationError(Exception):
    """A description that can't be carried out."""


class CorpusError(Exception):
    """Data that an operator can't work on."""
