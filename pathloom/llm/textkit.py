"""Vectorised word and shingle kernels over UTF-8 bytes (numpy), shared by the text operators.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D after A-Z are lower-cased. A word's 64-bit key takes eight
bytes at a time through a bijective mixer, so words of one length up to eight bytes have keys of their own and longer ones meet
non-linear steps that structured texts can't cancel; words over ``LONG`` bytes are hashed by keyed BLAKE2. Documents
never share a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2_000_000  #: texts are worked on in pieces of about this size; a longer text is a piece of its own

LONG = 64  #: bytes from which on a word is hashed by itself

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOLDED = _LOWER.copy()
_FOLDED[range(0x09, 0x0E)] = 0x20
_MASK = np.array([0, *(2 ** (8 * n) - 1 for n in range(1, 9))], np.uint64)
_SEED = np.uint64(0x9E3779B97F4A7C15)
_GRAM_KEYS = np.random.RandomState(77).randint(1, 2**62, 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one little-endian number, zeros behind the end (and 16 places more)."""
    return np.ndarray(len(data) + 17, "<u8", np.concatenate((data, np.zeros(24, np.uint8))), 0, (1,))


def run_keys(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit key of each run of bytes."""
    size = end - first
    eight = lanes(data)
    keys = mix64((eight[first] & _MASK[np.minimum(size, 8)]) + _SEED * size.astype(np.uint64))
    rest = np.flatnonzero((size > 8) & (size <= LONG))
    at = 8
    while len(rest):
        more = eight[first[rest] + at] & _MASK[np.minimum(size[rest] - at, 8)]
        keys[rest] = mix64((keys[rest] + _SEED) ^ more)
        at += 8
        rest = rest[size[rest] > at]
    for k in np.flatnonzero(size > LONG).tolist():
        keys[k] = int.from_bytes(blake2b(data[first[k] : end[k]], digest_size=8, key=b"word").digest(), "little")
    return keys


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row has no bytes."""
    column = column.fill_null("").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def binary(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a column of packed little-endian numbers, and row offsets; a null row has none."""
    column = column.fill_null(b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, kind), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(kind), (offs - offs[0]) // np.dtype(kind).itemsize


def packed(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Binary column of the values between the offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((offs * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def pieces(data: np.ndarray, offs: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``size`` bytes: (first row, end row, bytes, offsets from 0)."""
    row, rows = 0, len(offs) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + size, "right")) - 1)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first byte, end byte) of every word, and each row's first word as offsets."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offs), np.int64)
    folded = _FOLDED[data]
    inside = folded != 0x20
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begins, ends = inside.copy(), np.ones(n, bool)
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] = ~inside[1:] | edge[1:-1]
    ends &= inside
    first, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return run_keys(folded, first, end), first, end, np.searchsorted(first, offs)


def shingles(keys: np.ndarray, word_offs: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each row's sorted distinct ``width``-word shingle keys; fewer words make one shingle, no words none."""
    m = len(keys) - width + 1
    if m > 0:
        grams = keys[:m] * _GRAM_KEYS[0]
        for k in range(1, width):
            grams += keys[k : k + m] * _GRAM_KEYS[k]
        grams = mix64(grams)
    out = []
    for a, b in zip(word_offs[:-1], word_offs[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(mix64((keys[a:b] * _GRAM_KEYS[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
