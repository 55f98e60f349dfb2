"""What a request can be refused for."""


class InvalidPattern(ValueError):
    """The text is not a valid pattern in the user-facing dialect."""


class ConfigError(ValueError):
    """A setting or a glob is not usable."""


class InvalidRequest(ValueError):
    """The request itself makes no sense."""


class FileAccessError(OSError):
    """The root cannot be read."""
