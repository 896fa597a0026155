"""Byte views of Arrow string columns: whitespace words and their positions, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text looked at together; keeps the arrays of 8 bytes a position near the CPU's cache.
CHUNK = 1 << 19


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `size` bytes; one longer document makes a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and for each document the index of its first word (and the total)."""
    n = len(data)
    space = np.ones(n + 1, bool)
    np.logical_or(data == 32, (data - np.uint8(9)) < 5, out=space[:n])
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.ones(n + 1, bool)
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | first))
    closing = ~space[:n] & (space[1:] | first[1:])
    ends = np.flatnonzero(closing) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def stretches(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of marked bytes; a run ends with its document."""
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    starts = np.flatnonzero(inside & (~before[:-1] | first[:-1]))
    ends = np.flatnonzero(inside & (~np.append(inside[1:], False) | first[1:])) + 1 if n else starts
    return starts, ends


def as_strings(data: np.ndarray, kept: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The kept bytes, cut into strings of these lengths."""
    places = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[kept])))
