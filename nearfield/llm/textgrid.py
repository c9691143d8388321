"""Vectorised word splitting and hashing over Arrow string columns.

A batch of texts is one byte buffer. Words are maximal runs of word bytes inside one
text; each gets a 64-bit hash of its bytes, computed with prefix sums of a polynomial
over a keyed byte table, so no Python object is made per word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
PIECE = 1 << 18  # bytes hashed at once: the working arrays stay in cache and memory is bounded
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, U(BASE)), np.full(n, U(inverse))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls count as empty. offsets[0] is 0."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def _cuts(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> list[int]:
    """Positions that split the buffer into pieces of about PIECE bytes, never inside a word."""
    cuts, at, n = [0], 0, len(data)
    while n - at > PIECE:
        to = at + PIECE
        k = int(np.searchsorted(offsets, to, "right")) - 1
        if offsets[k] > at:
            to = int(offsets[k])
        else:
            while to < n and to < offsets[k + 1] and kind[LOWER[data[to]]]:
                to += 1
        cuts.append(to)
        at = to
    return [*cuts, n]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every text and the number of words at the end)."""
    found, places = [], []
    cuts = _cuts(data, offsets, kind)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if lo == hi:
            continue
        b = LOWER[data[lo:hi]]
        w = kind[b]
        cut = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "left")] - lo
        first = w.copy()
        first[1:] &= ~w[:-1]
        first[cut] = w[cut]
        last = w.copy()
        last[:-1] &= ~w[1:]
        last[cut - 1] = w[cut - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        size = PIECE if hi - lo <= PIECE else 1 << int(hi - lo).bit_length()
        up, down = _powers(size)
        terms = BYTES[b] * up[: hi - lo]
        h = np.cumsum(terms, dtype=U)
        found.append(mix((h[e] - h[s] + terms[s]) * down[s] + (e - s).astype(U)))
        places.append(s + lo)
    if not found:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    places = np.concatenate(places)
    return np.concatenate(found), np.searchsorted(places, offsets, "left")


def word_hashes(strings: list[str], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return words(*buffers(pa.array(strings, pa.large_string())), kind)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` consecutive entries of ``h`` (those across texts too)."""
    if len(h) < k:
        return np.zeros(0, U)
    total = np.zeros(len(h) - k + 1, U)
    for j in range(k):
        total += mix(h[j : len(h) - k + 1 + j] + U((j + 1) * 0x632BE59BD9B4E019 % (1 << 64)))
    return mix(total)


def runs(h: np.ndarray) -> int:
    """The hash of a whole short sequence, equal for equal sequences."""
    return int(windows(h, len(h))[0])


def blocks(batch: pa.RecordBatch, name: str, most: int = 2 << 20):
    """Slices of ``batch`` with about ``most`` bytes of ``name`` each (one row at least)."""
    column = batch.column(name)
    at, n = 0, batch.num_rows
    if not n:
        return
    _, o = buffers(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(o, o[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
