"""Typed errors raised by the ingest and query flows."""

from __future__ import annotations


class FlowError(Exception):
    """Base error: message, the step it came from, and the cause."""

    def __init__(self, message: str, step: str = "", cause: Exception | None = None):
        super().__init__(message)
        self.message, self.step, self.cause = message, step, cause

    def __str__(self) -> str:
        text = f"[{self.step}] {self.message}" if self.step else self.message
        return f"{text} (caused by {self.cause!r})" if self.cause else text


class IngestError(FlowError):
    pass


class QueryError(FlowError):
    pass


class FieldError(FlowError):
    """A column or setting is missing or has the wrong type."""

    def __init__(self, step: str, field: str, expected: type | str):
        name = expected if isinstance(expected, str) else expected.__name__
        super().__init__(f"field '{field}' must be {name}", step)
        self.field = field


class RowValidationError(IngestError):
    pass


class ClaimLostError(IngestError):
    pass


class ConfigError(FlowError):
    """The session lacks a setting that the job needs."""
