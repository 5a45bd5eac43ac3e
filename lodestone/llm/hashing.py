"""Hashes of the words and of the stretches of many texts at once, over their UTF-8 bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: The base of polynomial hashes.
_P = 0x9E3779B97F4A7C15
#: Bytes whose prefixes are hashed at once, at most.
LONGEST = 1 << 20
_U = np.uint64


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^n, modulo 2^64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def prefix(b: np.ndarray) -> np.ndarray:
    """Polynomial hashes of b's prefixes, modulo 2^64."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + _U(1)) * _POWERS[: len(b)], out=out[1:])
    return out


_POWERS = powers(_P, LONGEST)
_INVERSE = powers(pow(_P, -1, 1 << 64), LONGEST)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word [^\\x20\\x09-\\x0D]+ of the texts raw[bounds[i]:bounds[i+1]].

    A hash is a row of two 64-bit numbers: the 128-bit BLAKE2b of the word's bytes, so a word has one hash whatever it
    stands by and however long it is, and nobody can make two words with one hash. Each distinct word is hashed once.
    """
    w = ~WHITE[raw]
    begins = w.copy()
    begins[1:] &= ~w[:-1]
    ends = w.copy()
    ends[:-1] &= ~w[1:]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    begins[inner] |= w[inner]
    ends[inner - 1] |= w[inner - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return np.empty((0, 2), np.uint64), start, stop
    packed, offsets = raw[w], np.concatenate([[0], np.cumsum(stop - start)])
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    coded = column.dictionary_encode()
    known = b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in coded.dictionary.to_pylist())
    return np.frombuffer(known, np.uint64).reshape(-1, 2)[coded.indices.to_numpy()], start, stop


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k adjacent items of h: each item is mixed into what the ones before it gave."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix((out * _U(0xD1342543DE82EF95)) ^ h[i : i + n])
    return out
