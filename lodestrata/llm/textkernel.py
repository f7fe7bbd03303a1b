"""Vectorised tokenisation and hashing over the byte buffer of an Arrow column."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words as the runs of bytes that are not ASCII white space, and of letters, digits and non-ASCII bytes.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
#: Bytes, or items, that are hashed together.
BLOCK = 1 << 18


def _powers_of(base: int, n: int) -> np.ndarray:
    seq = np.full(n, base, np.uint64)
    seq[0] = 1
    return np.multiply.accumulate(seq)


@lru_cache(1)
def _kept() -> tuple[np.ndarray, np.ndarray]:
    return _powers_of(_P, BLOCK + 1), _powers_of(_PINV, BLOCK + 1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64; those beyond a block are not kept."""
    if n <= BLOCK + 1:
        return _kept()[0][:n], _kept()[1][:n]
    return _powers_of(_P, n), _powers_of(_PINV, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and each row's start with the end."""
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans(raw: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of `word` bytes, none over two rows; and each row's first run, with the end."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = word[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    now, before = inside[1:], inside[:-1]
    starts = np.flatnonzero(now & (~before | edge))
    ends = np.flatnonzero(before & (~now | edge))
    return starts, ends, np.searchsorted(starts, off)


def _polynomial(piece: np.ndarray) -> np.ndarray:
    """At each place, with the end, the sum of (byte + 1) * base^place before it."""
    total = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * powers(len(piece) + 1)[0][:-1], out=total[1:])
    return total


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a polynomial modulo 2^64, mixed with the length; block by block."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        if ends[at] - base > BLOCK:  # one span beyond a block
            found = 0
            for lo in range(base, int(ends[at]), BLOCK):
                found += int(_polynomial(raw[lo : min(int(ends[at]), lo + BLOCK)])[-1]) * pow(_P, lo - base, 1 << 64)
            out[at] = found % (1 << 64)
        else:
            total = _polynomial(raw[base : int(ends[to - 1])])
            out[at:to] = (total[ends[at:to] - base] - total[starts[at:to] - base]) * powers(BLOCK + 1)[1][starts[at:to] - base]
        at = to
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def rows_of(first: np.ndarray) -> np.ndarray:
    """For each item the row it is in, from each row's first item with the end."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
