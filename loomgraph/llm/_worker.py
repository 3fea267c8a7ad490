"""Memory of Python workers, which stay for later tasks beside the executor's heap."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Parameters of glibc: blocks from a megabyte on are mapped, and a free end of the heap of a megabyte is given back.
_MMAP_THRESHOLD, _TRIM_THRESHOLD, _MEGABYTE = -3, -1, 1 << 20
_LIBC: list = []


def _libc():
    if not _LIBC:
        try:
            found = ctypes.CDLL(None)
            found.mallopt(_MMAP_THRESHOLD, _MEGABYTE)
            found.mallopt(_TRIM_THRESHOLD, _MEGABYTE)
        except (AttributeError, OSError):  # another libc: it keeps its own rules
            found = None
        _LIBC.append(found)
    return _LIBC[0]


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with freed memory given back at the end of the task."""

    def task(batches):
        _libc()
        try:
            yield from run(batches)
        finally:
            release()

    return task
