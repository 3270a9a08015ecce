"""Arrow helpers for the vectorised kernels."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


try:
    _malloc_trim = ctypes.CDLL(ctypes.util.find_library("c")).malloc_trim
except (OSError, AttributeError, TypeError):  # not glibc
    _malloc_trim = None


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task and would keep what its largest batch took."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


def bytes_list(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and the offsets of each; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if len(column) and column.buffers()[2] else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(column) else (data[:0], np.zeros(1, np.int64))


def pieces(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most max_bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
        give_back()


def complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """From batches sorted by keys, tables that never split a group; only the last group of a batch is carried on."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            c = batch.column(k).to_numpy(zero_copy_only=False)
            same &= c == c[-1]
        cut = int(np.argmax(same[::-1] == False)) if not same.all() else batch.num_rows  # noqa: E712  rows of the last group
        head = batch.num_rows - cut
        joined = not rest or all(rest[0].column(k)[0].as_py() == batch.column(k)[0].as_py() for k in keys)
        if rest and not joined:
            yield pa.Table.from_batches(rest)
            rest = []
        if head:
            yield pa.Table.from_batches([*rest, batch.slice(0, head)])
            rest = []
        rest.append(batch.slice(head))
    if rest:
        yield pa.Table.from_batches(rest)
