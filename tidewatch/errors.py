"""Public exceptions. Each also subclasses ``ValueError`` so broad handlers keep working."""


class TidewatchError(Exception):
    """Root of every error raised on purpose by this package."""


class SchemaError(TidewatchError):
    """Data or a request does not fit the event schema."""


class UnknownFieldError(SchemaError, ValueError):
    """A field path is not registered for the event class."""


class UnsupportedClassError(SchemaError, ValueError):
    """A class_uid outside the supported event classes."""


class StorageError(TidewatchError):
    """An event-store operation cannot be carried out."""


class PartitionNotFoundError(StorageError, ValueError):
    """The event store holds no data for the requested class."""


class ReplaySessionNotFoundError(StorageError, ValueError):
    """The replay store holds no data for the requested session."""


class RegistrationError(TidewatchError):
    """Something had to be registered first."""


class UnregisteredFormatError(RegistrationError, ValueError):
    """No field mapping is registered for a (format, class) pair."""


class RuleError(TidewatchError):
    """A rule lifecycle step is not allowed."""


class RuleNotFoundError(RuleError, ValueError):
    """The rule id is unknown."""


class RuleNotConfirmedError(RuleError, ValueError):
    """The rule exists, but its latest version is not confirmed."""


class SharedFolderError(StorageError, RuntimeError):
    """No folder is configured that all executors share."""


class ConcurrentUpdateError(StorageError, RuntimeError):
    """Another writer was faster; read again and repeat the update."""
