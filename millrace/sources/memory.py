"""Memory of Python workers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import inspect
from collections.abc import Callable

import pyarrow as pa


#: Caches of this process that outlive a task.
_kept: list = []


def kept(cached: Callable) -> Callable:
    """A cached function (of functools) whose results serve later tasks of the thrifty functions that name it."""
    _kept.append(cached)
    return cached


def thrifty(run: Callable, uses: Callable | None = None) -> Callable:
    """A function over batches, or over a group, that gives its memory back to the system when it ends: Spark keeps Python workers for later tasks, and what they hold meanwhile counts against the executor.

    What was kept for others than the one it uses goes before it begins.
    """

    @functools.wraps(run)
    def batches(*args):
        let_go(uses)
        try:
            yield from run(*args)
        finally:
            give_back()

    @functools.wraps(run)
    def group(*args):
        let_go(uses)
        try:
            return run(*args)
        finally:
            give_back()

    return batches if inspect.isgeneratorfunction(run) else group


def let_go(uses: Callable | None) -> None:
    """Empty the kept caches but one."""
    others = [c for c in _kept if c is not uses and c.cache_info().currsize]
    for c in others:
        c.cache_clear()
    if others:
        give_back()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)
