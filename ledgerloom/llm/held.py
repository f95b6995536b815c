"""What a Python worker keeps between tasks: the tables of one operator at a time."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_held: dict[Any, Any] = {}


def held(make: Callable[[Any], Any], key: Any) -> Any:
    """The value of ``make(key)``, made once while no other is asked for.

    Workers live on through all stages of a job, so tables of an operator that
    ran before would take memory from the one that runs now."""
    at = (make, key)
    if at not in _held:
        _held.clear()
        gc.collect()
        _held[at] = make(key)
    return _held[at]


@contextlib.contextmanager
def uncollected():
    """No search for cycles meanwhile: walking large tables without any, again and again, takes a fifth of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def give_back() -> None:
    """Return freed memory to the system: workers share their machine with the JVM and with each other."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
