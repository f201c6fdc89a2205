"""Vectorised views of text batches: bytes, words and word hashes without a Python loop over words.

A batch is cut into pieces of about a megabyte, so memory does not follow the batch; one text longer
than that is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_B = 0x9E3779B97F4A7C15 | 1
_BI = pow(_B, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}

#: Words are runs of bytes outside the space and the controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        size = max(n, 2 * PIECE)
        for key, base in (("p", _B), ("i", _BI)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POW[key] = np.cumprod(a)
    return _POW["p"][:n], _POW["i"][:n]


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 4096)
        a, b = int(offsets[lo]), int(offsets[hi])
        yield lo, hi, raw[a:b], offsets[lo : hi + 1] - a
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the row of each; no word crosses a text's end."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~space[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, moved to its start, then mixed."""
    p, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
    value = (total[ends] - total[starts]) * inverse[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_word(word: bytes) -> int:
    """The hash of one word, as ``word_hashes`` gives it."""
    data = np.frombuffer(word, np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def chain(hashes: list[np.ndarray]) -> np.ndarray:
    """An ordered hash of aligned columns of hashes."""
    out = hashes[0]
    for x in hashes[1:]:
        out = mix(out * np.uint64(0xFF51AFD7ED558CCD) + x)
    return out


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``k`` words; a text with 1 to k-1 words gives its whole sequence."""
    n = len(hashes)
    at = np.arange(max(0, n - k + 1))
    at = at[rows[at] == rows[at + k - 1]] if len(at) else at
    out, row = chain([hashes[at + j] for j in range(k)]) if len(at) else np.zeros(0, np.uint64), rows[at]
    count = np.bincount(rows, minlength=n_rows)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(rows, short)
        value = hashes[first]
        for j in range(1, k - 1):
            more = count[short] > j
            value = np.where(more, chain([value, hashes[np.minimum(first + j, n - 1)]]), value)
        value = mix(value ^ (count[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        out, row = np.concatenate([out, value]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        out, row = out[order], row[order]
    return out, row


def unique(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
