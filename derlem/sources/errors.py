"""Faults of what stands outside: kinds of them, and calls that are tried again."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
#: Codes by which a service says that the request itself is wrong.
REQUEST_CODES = ("VALIDATION", "BAD_REQUEST", "INVALID_PARAMETER")
#: What a message says when a field could not be read.
PARSE_MARKS = ("Cannot deserialize", "JSON parse error", "Failed to convert")


class SourceError(Exception):
    """A fault of a source; it is raised, never turned into an empty result."""

    def __init__(self, code: str, message: str = "", source: str = "") -> None:
        super().__init__(f"{source or 'source'}: {code} {message}".strip())
        self.code, self.message, self.source = code, message, source

    @property
    def kind(self) -> str:
        """parameter: a field could not be read; request: the same request will fail again; transient: it may not."""
        if any(m in self.message for m in PARSE_MARKS):
            return "parameter"
        return "request" if any(c in self.code.upper() for c in REQUEST_CODES) else "transient"

    @property
    def retryable(self) -> bool:
        return self.kind == "transient"


def checked(answer: dict, source: str = "") -> dict:
    """An answer without an error in it; one that carries an error code is a fault, whatever its status says."""
    for field in ("error", "errorCode", "fault"):
        if answer.get(field):
            raise SourceError(str(answer[field]), str(answer.get("message", "")), source)
    return answer


def retried(call: Callable[[], T], times: int = 3, first_wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> T:
    """The result of a call that is made again after transient faults, each time after twice the wait."""
    for i in range(times):
        try:
            return call()
        except (SourceError, OSError) as e:
            if i + 1 == times or (isinstance(e, SourceError) and not e.retryable):
                raise
            sleep(first_wait * 2**i)
    raise ValueError("a call is made at least once")
