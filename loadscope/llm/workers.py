"""Memory of Python workers.

Spark keeps a worker for the tasks of later stages, and what a task has freed stays with
the allocators: a stage would begin with the memory of the largest stage before it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Return freed memory to the system; without glibc only that of Arrow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same batches; at the end of the task the worker gives back what ``run`` has freed."""

    @wraps(run)
    def inner(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return inner
