"""Errors of the engine; each class has the SQLSTATE of its kind."""

from __future__ import annotations


class EngineError(Exception):
    sqlstate = "XX000"


class MetadataNotFound(EngineError):
    sqlstate = "P0001"


class ModelAlreadyExists(EngineError):
    sqlstate = "42710"


class InvalidName(EngineError):
    sqlstate = "42602"


class DependencyCycle(EngineError):
    sqlstate = "55P03"


class DepthExceeded(EngineError):
    sqlstate = "54001"


class DependencyUnresolved(EngineError):
    sqlstate = "55000"


class InvalidSelect(EngineError):
    sqlstate = "42601"


class RequiredColumnMissing(EngineError):
    sqlstate = "42703"


class TypeMismatch(EngineError):
    sqlstate = "42804"


class LockConflict(EngineError):
    sqlstate = "40P01"


class DuplicateKey(EngineError):
    sqlstate = "23505"


class PropagationDepthExceeded(DepthExceeded):
    """More levels of models than a commit may refresh."""
