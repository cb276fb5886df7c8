"""Spans and log records of operations.

Spans nest: an operation holds the check and compilation of its arguments (build) and, where it runs at once, its
execution (execute); a transaction holds the operations in it. Reads are DataFrames that haven't run, so a read has no
execute span of its own, but for those that must find a row.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

logger = logging.getLogger("mosaiq")
#: Kinds of log records, and the level at which the logger gets them.
LEVELS = {"query": logging.DEBUG, "cache": logging.DEBUG, "warning": logging.WARNING, "error": logging.ERROR}
_handlers: ContextVar[dict[str, Callable[[dict], None]]] = ContextVar("mosaiq_handlers", default={})
_parent: ContextVar[str | None] = ContextVar("mosaiq_parent", default=None)


@contextmanager
def handled(handlers: dict[str, Callable[[dict], None]]) -> Iterator[None]:
    """Within it, records of these kinds (and spans, under "span") go to the functions too."""
    token = _handlers.set({**_handlers.get(), **handlers})
    try:
        yield
    finally:
        _handlers.reset(token)


def emit(kind: str, **record: Any) -> None:
    logger.log(LEVELS.get(kind, logging.DEBUG), "%s %s", kind, record)
    if (f := _handlers.get().get(kind)) is not None:
        f({"kind": kind, **record})


@contextmanager
def span(name: str, values: bool = False, **attributes: Any) -> Iterator[dict]:
    """Times a step and tells of it; argument values are left out unless `values` is set."""
    shown = attributes if values else {k: v for k, v in attributes.items() if k != "args"}
    out: dict[str, Any] = {"name": name, "parent": _parent.get(), **shown}
    began, token = time.perf_counter(), _parent.set(name)
    try:
        yield out
    except Exception as e:
        out["error"] = type(e).__name__
        emit("error", name=name, error=type(e).__name__, **({"message": str(e)} if values else {}))
        raise
    finally:
        _parent.reset(token)
        out["ms"] = round((time.perf_counter() - began) * 1000, 3)
        emit("span", **out)
