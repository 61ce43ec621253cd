"""Errors of the comparison engine."""


class KeyTypesDiffer(Exception):
    """Key columns of the two sides have different kinds of values."""


class QueryBuildError(Exception):
    """A builder expression that makes no query."""


class AgeError(ValueError):
    """A relative age that can't be read."""


class ConfigError(ValueError):
    """A configuration that can't be read."""


class ConnectError(Exception):
    """A source address that can't be understood."""
