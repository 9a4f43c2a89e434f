"""Errors as callers see them: a code, a status and a message, in one envelope."""

from __future__ import annotations


class EngineError(Exception):
    """``status`` is the name of what went wrong and ``code`` its HTTP number."""

    status, code = "INTERNAL", 500

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details


class InvalidArgument(EngineError, ValueError):
    status, code = "INVALID_ARGUMENT", 400


class NotFound(EngineError, KeyError):
    status, code = "NOT_FOUND", 404

    def __str__(self) -> str:
        return self.args[0]


class AlreadyExists(EngineError):
    status, code = "ALREADY_EXISTS", 409


def envelope(error: Exception) -> dict:
    """``{"error": {code, status, message, details}}``; what is no error of the engine tells its kind and no more."""
    if isinstance(error, EngineError):
        return {"error": {"code": error.code, "status": error.status, "message": str(error), "details": [error.details] if error.details else []}}
    if isinstance(error, ValueError):
        return {"error": {"code": 400, "status": "INVALID_ARGUMENT", "message": str(error), "details": []}}
    return {"error": {"code": 500, "status": "INTERNAL", "message": type(error).__name__, "details": []}}
