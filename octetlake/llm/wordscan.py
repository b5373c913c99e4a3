"""Vectorised word scanning over the bytes of Arrow string columns.

A word is a run of ASCII letters, digits and bytes from 0x80 up, after A-Z were lower-cased; on
UTF-8 that is the contracts' `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Spark partitions the rows; these
helpers only replace a per-word Python loop inside a task. Texts are taken in slices of about
SLICE bytes, so memory does not follow the batch; one text longer than that is cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15
_POWER = np.ones(1, dtype=np.uint64)
_INVERSE = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse, up to n."""
    global _POWER, _INVERSE
    if len(_POWER) < n:
        n = max(n, SLICE + 1)
        p = np.full(n, _BASE, dtype=np.uint64)
        q = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        p[0] = q[0] = 1
        _POWER, _INVERSE = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
    return _POWER, _INVERSE


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(len(col) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    return off, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)


def row_slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about limit bytes; a longer row stands alone."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


@dataclass
class Words:
    """The words of rows first..last of a batch, in order."""

    first: int
    last: int
    counts: np.ndarray  # words of each row
    hashes: np.ndarray  # uint64 of each word
    starts: np.ndarray  # place of each word's first byte in the buffer
    ends: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """The row of each word, from 0."""
        return np.repeat(np.arange(self.last - self.first), self.counts)


def _scan(low: np.ndarray, base: int, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in low, which begins at base; no word crosses a break."""
    if len(low) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = IS_WORD[low]
    before = np.zeros(len(low), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(low), dtype=bool)
    after[:-1] = inside[1:]
    cut = breaks[(breaks > 0) & (breaks < len(low))]
    before[cut] = False
    after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    if len(starts) == 0:
        return np.zeros(0, np.uint64), starts, ends
    power, inverse = _powers(len(low))
    part = (low.astype(np.uint64) + np.uint64(1)) * power[: len(low)]
    part[~inside] = 0
    h = mix(np.add.reduceat(part, starts) * inverse[starts])
    return h, starts + base, ends + base


def words(off: np.ndarray, data: np.ndarray) -> Iterator[Words]:
    """The words of all rows, slice by slice."""
    for a, b in row_slices(off):
        lo, hi = int(off[a]), int(off[b])
        if hi - lo <= SLICE or b - a > 1:
            h, s, e = _scan(LOWER[data[lo:hi]], lo, off[a : b + 1] - lo)
            counts = np.diff(np.searchsorted(s, off[a : b + 1]))
        else:
            parts, at = [], lo
            while at < hi:
                end = min(hi, at + SLICE)
                if end < hi:  # cut after the last byte that belongs to no word, or else after the word
                    tail = np.flatnonzero(~IS_WORD[LOWER[data[at:end]]])
                    if len(tail):
                        end = at + int(tail[-1]) + 1
                    else:
                        while end < hi and IS_WORD[LOWER[data[end]]]:
                            end += 1
                parts.append(_scan(LOWER[data[at:end]], at, np.zeros(0, dtype=np.int64)))
                at = end
            h, s, e = (np.concatenate([p[i] for p in parts]) for i in range(3))
            counts = np.array([len(s)])
        yield Words(a, b, counts, h, s, e)


def normal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The lower-cased words, joined by single spaces."""
    return b" ".join(LOWER[data[s:e]].tobytes() for s, e in zip(starts, ends, strict=True))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes; element i covers words i to i+n-1."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    # doubling: a block of 2k is two blocks of k, and what is left is one more block that starts later
    k, cur = 1, h * np.uint64(0xD6E8FEB86659FD93)
    done, out = 0, None
    rest = n
    while rest:
        if rest & 1:
            out = cur[done : done + m].copy() if out is None else mix(out + np.uint64(0xA0761D6478BD642F)) + cur[done : done + m]
            done += k
        rest >>= 1
        if rest:
            cur = mix(cur[: len(cur) - k]) * np.uint64(0xE7037ED1A0B428DB) + cur[k:]
            k *= 2
    return mix(out)
