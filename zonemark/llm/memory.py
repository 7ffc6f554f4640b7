"""Giving memory back: Python workers live on between tasks, beside the executor's JVM."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """What the allocators hold of freed arrays goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # an allocator without it
        pass


#: What operators keep in a worker for the tasks to come, by operator.
_KEPT: dict[str, dict] = {}


def keeps(operator: str) -> dict:
    """A dictionary that a worker keeps as long as it works for an operator."""
    return _KEPT.setdefault(operator, {})


def lean(run: Run, operator: str = "") -> Run:
    """A function for mapInArrow that gives memory back after each batch that it makes and at its end, and
    before it begins what other operators have kept."""

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, kept in _KEPT.items():
            if name != operator:
                kept.clear()
        try:
            for b in run(batches):
                yield b
                del b
                give_back()
        finally:
            give_back()

    return inner
