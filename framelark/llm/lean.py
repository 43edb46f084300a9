"""Python workers outlive their tasks: what a task no longer needs goes back to the system at its end."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

#: Called at the end of every task: they drop memories that only save work within a task.
_AT_END: list[Callable[[], None]] = []
_LARGE = 4 << 20

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def at_task_end(forget: Callable[[], None]) -> Callable[[], None]:
    _AT_END.append(forget)
    return forget


def give_back() -> None:
    """Return freed memory to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _finish() -> None:
    for forget in _AT_END:
        forget()
    gc.collect()
    give_back()


def lean_map(run):
    """For ``mapInArrow``: tidy up when the task's batches are done."""

    def mapped(batches):
        try:
            yield from run(batches)
        finally:
            _finish()

    return mapped


def lean_table(run):
    """For ``groupBy(...).applyInArrow`` without a key: tidy up after each large group."""

    def grouped(table):
        out = run(table)
        if table.nbytes > _LARGE:
            _finish()
        return out

    return grouped


def lean_group(run):
    """For ``groupBy(...).applyInArrow`` with a key: tidy up after each large group."""

    def grouped(key, table):
        out = run(key, table)
        if table.nbytes > _LARGE:
            _finish()
        return out

    return grouped


def lean_cogroup(run):
    """For ``cogroup(...).applyInArrow`` with a key: tidy up after each large group."""

    def grouped(key, left, right):
        out = run(key, left, right)
        if left.nbytes + right.nbytes > _LARGE:
            _finish()
        return out

    return grouped
