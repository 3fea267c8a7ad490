"""Words of whole Arrow batches as hashes, without a Python loop over words.

Texts are read as the UTF-8 bytes Arrow holds. Word separators are ASCII, so
bytes are enough to find words. A word's hash is a polynomial over random values
of its bytes modulo 2**64, taken from running sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEGMENT = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: True for the bytes of a word: all but space and 0x09 to 0x0D.
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit integers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * _BASE)


def byte_values(lower: bool) -> np.ndarray:
    """A random value for each byte; with ``lower`` A-Z count as a-z."""
    values = stream(256, 77)
    if lower:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, _SEGMENT + 4096), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * _SEGMENT:
            _POWERS[int(base)] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def row_slices(offsets: np.ndarray, size: int = _SEGMENT >> 1) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about ``size`` bytes; a longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a word ends where its row ends."""
    inside = IN_WORD[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = np.unique(offsets)
    begin, end = edges[edges < len(buf)], edges[edges > 0] - 1
    first[begin] |= inside[begin]
    last[end] |= inside[end]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(buf: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each row the index of its first word (one more at the end)."""
    starts, ends = spans(buf, offsets)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # pieces of bounded size; a longer word stands alone
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SEGMENT, "right")))
        low, high = starts[at], ends[to - 1]
        n = int(high - low)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values[buf[low:high]] * _powers(_BASE, n), out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((total[e] - total[s]) * _powers(_INVERSE, n)[s] + (e - s).astype(np.uint64))
        at = to
    return out, np.searchsorted(starts, offsets)


_WINDOW = stream(16, 5) | np.uint64(1)


def shingles(words: np.ndarray, first: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its windows of ``width`` words.

    A row with fewer words has one shingle, its whole sequence; one without words has none.
    """
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width if n >= width else 0):
        rolled += words[k : n - width + 1 + k] * _WINDOW[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            part = words[a:b] * _WINDOW[: b - a]
            out.append(mix(np.array([part.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
