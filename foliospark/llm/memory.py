"""Bounded memory in Python workers: batches in slices of so many bytes, and freed memory back to the system."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of groups after which a worker gives memory back.
ENOUGH = 16 << 20

_libc: list = []


def give_back() -> None:
    """A worker stays for later tasks; what its allocators keep would count against the executor until then."""
    pa.default_memory_pool().release_unused()
    if not _libc:
        try:
            _libc.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):  # another C library
            _libc.append(lambda _: 0)
    _libc[0](0)


def lean(run: Callable) -> Callable:
    """A mapInArrow function that gives memory back when its task ends."""

    @wraps(run)
    def wrapped(it):
        try:
            yield from run(it)
        finally:
            give_back()

    return wrapped


def lean_groups(run: Callable) -> Callable:
    """A function of one or two group tables that gives memory back after each ENOUGH bytes of them."""
    seen = [0]

    def done(*tables: pa.Table) -> None:
        seen[0] += sum(t.nbytes for t in tables)
        if seen[0] >= ENOUGH:
            seen[0] = 0
            give_back()

    def one(table: pa.Table) -> pa.Table:
        out = run(table)
        done(table, out)
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        done(left, right, out)
        return out

    return two if run.__code__.co_argcount == 2 else one


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` bytes in a string column, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j
