"""Exceptions, each with a stable code. The codes are fixed values."""

from __future__ import annotations


class MosaiqError(Exception):
    code = "V9001"

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details


class ValidationError(MosaiqError):
    """An argument of the wrong shape: unknown keys, operators or values are refused, never ignored."""

    code = "V4001"


class SchemaError(MosaiqError):
    """A definition that can't be used; details["issues"] has (code, message) pairs."""

    code = "V4002"


class UnsupportedError(MosaiqError):
    code = "V8001"


class NotFoundError(MosaiqError):
    code = "V6001"


class ModelNotFoundError(MosaiqError):
    code = "V6002"


class UniqueConstraintError(MosaiqError):
    code = "V3001"


class ForeignKeyError(MosaiqError):
    code = "V3002"


class NotNullError(MosaiqError):
    code = "V3003"


class NestedWriteError(MosaiqError):
    code = "V7001"


class TransactionError(MosaiqError):
    code = "V5001"


class ConflictError(TransactionError):
    """Another writer committed first."""

    code = "V5004"


class CacheError(MosaiqError):
    code = "V10001"
