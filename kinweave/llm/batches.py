"""Words of Arrow text columns as numpy arrays: positions and 64-bit hashes, without Python strings.

Texts are cut at the separators 0x20 and 0x09 to 0x0D; these bytes never occur inside a UTF-8
character, so bytes suffice. A word's hash is a polynomial over random byte values, mixed at the end.
Rows are handled in pieces of half a MB, so memory follows the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from kinweave.plans.shipping import ship_by_value

ship_by_value(__name__)

PIECE = 1 << 19
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Kept(dict):
    """Filled where it is used; travels to workers empty."""

    def __reduce__(self):
        return _Kept, ()


_tables = _Kept()


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for the next call."""
    key = f"{base}"
    if key not in _tables or len(_tables[key]) < n:
        steps = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
        steps[0] = 1
        _tables[key] = np.cumprod(steps, dtype=np.uint64)
    return _tables[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Piece:
    """Some rows of a batch: ``first`` to ``last`` (exclusive), their bytes and row bounds in them."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


def pieces(text: pa.Array, limit: int = PIECE) -> Iterator[Piece]:
    """Runs of rows with at most ``limit`` bytes, or one longer row; NULL counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string()).fill_null("")
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield Piece(first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last


@dataclass
class Words:
    starts: np.ndarray  # byte positions
    ends: np.ndarray
    row: np.ndarray  # row within the piece
    per_row: np.ndarray  # words of each row
    hashes: np.ndarray


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * powers(_BASE, len(data)), dtype=np.uint64, out=total[1:])
    inverse = powers(pow(_BASE, -1, 1 << 64), len(data) + 1)
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def split(piece: Piece, lower: bool = False, hashed: bool = True) -> Words:
    """The words of a piece; ``lower`` hashes A-Z as a-z, ``hashed`` False leaves the hashes out."""
    data, bounds = piece.data, piece.bounds
    n = len(data)
    if lower:
        data = lowered(data)
    inside = ~_SPACE[data]
    edge = bounds[:-1][np.diff(bounds) > 0]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[edge[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(bounds, starts, "right") - 1
    per_row = np.bincount(row, minlength=len(bounds) - 1)
    return Words(starts, ends, row, per_row, span_hashes(data, starts, ends) if hashed else starts[:0].astype(np.uint64))


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, hash) of every run of ``n`` words of one row."""
    h = words.hashes
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):  # Horner's rule over odd multipliers: order matters
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + m]
    at = np.flatnonzero(words.row[:m] == words.row[n - 1 :])
    return at, mix(out[at])
