"""Bounded memory in the Python workers that serve Arrow functions."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_DEFAULT = "67108864b"
#: Bytes of an Arrow batch, unless the session sets its own bound; a longer row is a batch of its own.
BATCH = 4 << 20
# glibc's parameters: size from which memory is mapped, and given back when freed; size of the heap's top that is kept
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose rows will reach Arrow functions in batches of at most about ``BATCH`` bytes."""
    conf = df.sparkSession.conf
    if conf.get(_SETTING) == _DEFAULT:
        conf.set(_SETTING, str(BATCH))
    return df


@functools.cache
def _libc() -> ctypes.CDLL | None:
    """The C library, told to give freed blocks back; None where it isn't glibc."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(_MMAP_THRESHOLD, 1 << 20)
        libc.mallopt(_TRIM_THRESHOLD, 1 << 20)
    except (OSError, AttributeError):
        return None
    pa.set_memory_pool(pa.system_memory_pool())
    return libc


def tidy(run: Callable) -> Callable:
    """An Arrow function over batches whose worker gives its memory back at the end of each task."""

    @functools.wraps(run)
    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = _libc()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if libc is not None:
            libc.malloc_trim(0)

    return inside


def _trimmed(out: pa.Table) -> pa.Table:
    libc = _libc()
    if libc is not None:
        libc.malloc_trim(0)
    return out


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of a whole group."""

    def inside(table: pa.Table) -> pa.Table:
        return _trimmed(run(table))

    return inside


def tidy_pair(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two groups that meet."""

    def inside(left: pa.Table, right: pa.Table) -> pa.Table:
        return _trimmed(run(left, right))

    return inside
