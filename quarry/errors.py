"""One exception type, with a stable code and a context that says where."""

from __future__ import annotations

from enum import StrEnum


class ErrorCode(StrEnum):
    SYNTAX_ERROR = "SYNTAX_ERROR"
    BINDING_ERROR = "BINDING_ERROR"
    NOT_FOUND = "NOT_FOUND"
    CONFLICT = "CONFLICT"
    INVALID_REQUEST = "INVALID_REQUEST"
    LEASE_REJECTED = "LEASE_REJECTED"
    RESOURCE_EXHAUSTED = "RESOURCE_EXHAUSTED"
    TASK_FAILED = "TASK_FAILED"
    SERVICE_UNAVAILABLE = "SERVICE_UNAVAILABLE"
    INTERNAL_ERROR = "INTERNAL_ERROR"


#: HTTP statuses that differ from 400.
STATUS = {"NOT_FOUND": 404, "CONFLICT": 409, "INVALID_REQUEST": 422, "LEASE_REJECTED": 403, "RESOURCE_EXHAUSTED": 507, "TASK_FAILED": 500, "SERVICE_UNAVAILABLE": 503, "INTERNAL_ERROR": 500}


class EngineError(Exception):
    def __init__(self, code: ErrorCode, message: str, **context):
        super().__init__(message)
        self.code, self.message, self.context = code, message, context

    @property
    def status(self) -> int:
        return STATUS.get(self.code, 400)

    def as_dict(self) -> dict:
        return {"error": {"code": str(self.code), "message": self.message, "context": self.context}}


def from_spark(exc: Exception) -> EngineError:
    """A Spark failure under the engine's codes: what is missing, what ran out, what failed."""
    if isinstance(exc, EngineError):
        return exc
    text = str(exc)
    first = text.strip().splitlines()[0][:500] if text.strip() else type(exc).__name__
    if any(x in text for x in ("PATH_NOT_FOUND", "FileNotFoundException", "FAILED_READ_FILE.FILE_NOT_EXIST")):
        return EngineError(ErrorCode.NOT_FOUND, first)
    if any(x in text for x in ("OutOfMemory", "No space left", "UNABLE_TO_ACQUIRE_MEMORY")):
        return EngineError(ErrorCode.RESOURCE_EXHAUSTED, first)
    if any(x in text for x in ("is not a Parquet file", "FAILED_READ_FILE", "UNABLE_TO_INFER_SCHEMA", "Malformed")):
        return EngineError(ErrorCode.INVALID_REQUEST, first)
    return EngineError(ErrorCode.TASK_FAILED, first)
