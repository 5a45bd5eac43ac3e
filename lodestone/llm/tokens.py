"""Tokens of many texts at once, as runs of bytes of a class, and their codes in a dictionary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .hashing import buffers

#: Bytes of text that are taken at once; a longer text is a slab of its own.
SLAB = 16 << 20


def slabs(batches, text: int, size: int = SLAB) -> Iterator[pa.RecordBatch]:
    """The rows of batches, in pieces whose texts (column number text) have about so many bytes at most."""
    for batch in batches:
        _, bounds = buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def lowered(raw: np.ndarray) -> np.ndarray:
    """raw with A-Z in lower case."""
    return np.where((raw >= 0x41) & (raw <= 0x5A), raw | 0x20, raw)


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the runs of True in inside; runs do not cross the bounds of texts."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    inner = bounds[(bounds > 0) & (bounds < len(inside))]
    begins[inner] |= inside[inner]
    ends[inner - 1] |= inside[inner - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(bounds, start, "right") - 1


def coded(raw: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(code of each token, the distinct tokens as strings)."""
    if not len(start):
        return np.empty(0, np.int64), pa.array([], pa.string())
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    known = column.dictionary_encode()
    return known.indices.to_numpy().astype(np.int64), known.dictionary.cast(pa.large_string()).cast(pa.string())


def numbered_values(column: pa.Array, null: str) -> tuple[np.ndarray, list[str]]:
    """(code of each row, the distinct values) of a string column; a null is as the given value."""
    known = column.cast(pa.string()).fill_null(null).dictionary_encode()
    return known.indices.to_numpy().astype(np.int64), known.dictionary.to_pylist()
