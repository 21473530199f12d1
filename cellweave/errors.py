"""Errors of the library."""


class InputError(ValueError):
    """Data or options that an operator refuses."""


class ResourceLimitError(RuntimeError):
    """A result would exceed a stated limit; nothing was pruned."""

