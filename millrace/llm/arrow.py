"""Arrow batches in and out of Python workers."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from millrace.runtime import share_code
from pyspark.sql import DataFrame

#: Bytes of text that one Python call handles at a time, unless one text is longer.
CHARS = 2_000_000

#: What a worker process keeps between batches, such as a loaded tokenizer.
_KEPT = sys.modules.setdefault("_millrace_kept", types.ModuleType("_millrace_kept"))


def kept(key, make: Callable):
    """make() once per worker process and key; of a kind (a key's first part) the last value stays."""
    store = _KEPT.__dict__.setdefault("store", {})
    kind = key[0] if isinstance(key, tuple) else key
    if store.get(kind, (None,))[0] != key:
        store.pop(kind, None)  # the old value goes before the new one is made
        store[kind] = key, make()
    return store[kind][1]


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    share_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_little()
        try:
            yield from f(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def hold_little() -> None:
    """Let the C library give arrays of a megabyte or more back to the system once they are free (its bound grows to 32 MB by itself)."""
    kept("malloc", lambda: _c("mallopt", -3, 1 << 20))


def release() -> None:
    """Give free memory back to the system at the end of a task, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    _c("malloc_trim", 0)


def _c(name: str, *values: int) -> None:
    call = getattr(ctypes.CDLL(None), name, None)  # other systems lack these
    if call is not None:
        call(*values)


def slices(batches: Iterable[pa.RecordBatch], text_at: int, chars: int = CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about so many bytes of text, one row at least."""
    for batch in batches:
        size = np.cumsum(np.diff(offsets(batch.column(text_at))))
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, done + chars, side="right")))
            yield batch.slice(start, end - start)
            start = end


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary column, from its first row."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1] or b"\0" * 8, dtype=np.int64 if wide else np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def texts_of(column: pa.Array) -> list[str]:
    """Texts, null as empty."""
    return [t or "" for t in column.to_pylist()]
