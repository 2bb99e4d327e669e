"""Errors that callers can tell apart."""


class BadInput(ValueError):
    """An archive, manifest or request that can't be used."""


class Conflict(ValueError):
    """A whitelist code that exists already, or is still in use."""


class Unauthorized(PermissionError):
    """Unknown key."""


class Forbidden(PermissionError):
    """Known key, but too low a role."""
