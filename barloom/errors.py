"""Errors of the engine."""


class BarloomError(Exception):
    """Base of all."""


class ConfigError(BarloomError):
    """The configuration is incomplete or wrong."""


class ApiError(BarloomError):
    """A source kept failing."""
