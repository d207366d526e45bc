"""Errors that callers may want to tell apart."""


class SparkloomError(Exception):
    """Any error of this package."""


class ConfigError(SparkloomError):
    """A setting that can't be used."""


class FilterError(ConfigError):
    """A filter that isn't well formed."""


class AccessDenied(SparkloomError):
    """A caller without the identity that the access rules ask for."""


class ProviderError(SparkloomError):
    """A model or service that failed for good."""


class IngestError(SparkloomError):
    """Sources that can't be ingested as they are given."""


class MissingDependency(SparkloomError):
    def __init__(self, package: str, extra: str):
        super().__init__(f"{package} is needed here; install the {extra} extra")
