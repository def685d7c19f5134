"""Errors of the vector engine; all are ``ValueError``s."""


class EngineError(ValueError):
    """Any error of the engine."""


class ZeroNormVector(EngineError):
    """A cosine was asked for a vector without length."""


class IndexOutOfBounds(EngineError):
    """A row ordinal that a segment does not have."""


class InvalidVectorDimension(EngineError):
    """A vector of another length than the store's."""


class StorageError(EngineError):
    """A path that can't be read or written."""


class InvalidHeader(EngineError):
    """A manifest that isn't one."""


class UnsupportedVersion(EngineError):
    """A manifest of a later format."""


class InvariantViolation(EngineError):
    """A state that should not occur."""


class CodecError(EngineError):
    """Bytes that can't be decoded."""


class TaskError(EngineError):
    """A job that did not end well."""
