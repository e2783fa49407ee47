"""Errors of sources, what kind an error is, and how often a read is tried again."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of errors as logs and registries name them.
NETWORK, FILES, INTEGRITY, VALIDATION = "network_error", "file_system_error", "data_integrity_error", "validation_error"


class SourceError(RuntimeError):
    """A source that can't be read; ``details`` says which."""

    def __init__(self, message: str, **details: object) -> None:
        super().__init__(message)
        self.details = details


class RateLimited(SourceError):
    """The source asks to wait: trying again at once would make it worse."""

    def __init__(self, message: str = "rate limited", wait_s: float | None = None, **details: object) -> None:
        super().__init__(message, wait_s=wait_s, **details)
        self.wait_s = wait_s


class BadStatus(SourceError):
    """An answer with a status that isn't success."""

    def __init__(self, status: int, **details: object) -> None:
        super().__init__(f"status {status}", status=status, **details)
        self.status = status


class BadAnswer(SourceError):
    """An answer that can't be read, or that tells of an error."""


class Unreachable(SourceError):
    """No answer, or none in time."""


def kind_of(error: BaseException) -> str:
    """One of the kinds; what isn't known counts as bad input."""
    if isinstance(error, (BadAnswer, json.JSONDecodeError)):
        return INTEGRITY
    if isinstance(error, (SourceError, ConnectionError, TimeoutError)):
        return NETWORK
    if isinstance(error, OSError):
        return FILES
    return VALIDATION


def raise_for(status: int, wait_s: float | None = None, code: int | None = None) -> None:
    """The error of an answer: 429 and 418 are rate limits, other statuses from 400 and error codes are failures."""
    if status in (418, 429):
        raise RateLimited(wait_s=wait_s, status=status)
    if status >= 400:
        raise BadStatus(status)
    if code not in (None, 0, 200):
        raise BadAnswer(f"error code {code}", code=code)


def again(read: Callable[[], object], tries: int = 3, most_s: float = 120.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """What ``read`` gives, tried again after 1, 2, 4 ... seconds and up to one more; never after a rate limit.

    For use inside a task; Spark's own retries of tasks come on top.
    """
    for i in range(tries):
        try:
            return read()
        except RateLimited:
            raise
        except (SourceError, OSError, json.JSONDecodeError):
            if i + 1 == tries:
                raise
            sleep(min(most_s, 2.0**i) + random.uniform(0, 1))
    raise ValueError("at least one try is needed")


def answered(status: Column, code: Column) -> Column:
    """``error, kind, again`` of answers in a table, by the rules of :func:`raise_for`: the error, its kind and whether a read is tried again; null for sound ones."""
    error = F.when(status.isin(418, 429), RateLimited.__name__).when(status >= 400, BadStatus.__name__).when(~F.coalesce(code, F.lit(0)).isin(0, 200), BadAnswer.__name__)
    kind = F.when(error == BadAnswer.__name__, INTEGRITY).when(error.isNotNull(), NETWORK)
    return F.when(error.isNotNull(), F.struct(error.alias("error"), kind.alias("kind"), (error != RateLimited.__name__).alias("again")))
