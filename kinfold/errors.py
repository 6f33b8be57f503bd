"""Errors of the library."""


class KinfoldError(Exception):
    """Any error of the library."""


class SourceError(KinfoldError):
    """A source of unknown kind, or one that cannot be read."""


class MalformedCsv(SourceError):
    """A CSV file without a header that is known."""


class ConfigError(KinfoldError):
    """A projection config that cannot be used."""


class ProjectionError(KinfoldError):
    """A required field is missing and the config asks for an error."""


class ValidationError(KinfoldError):
    """Output that breaks what its config declares."""


class ScratchError(KinfoldError):
    """A cluster without a shared folder for intermediate tables."""
