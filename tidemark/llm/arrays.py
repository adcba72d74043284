"""Texts of Arrow batches as flat numpy arrays, shared by the operators of this subpackage.

Every helper takes whole texts.  `portions` cuts a batch by bytes of text, so temporary arrays stay small
however many long texts a batch holds; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PORTION_BYTES = 4 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
POWER_STEP = 1 << 18  # tables of powers grow by this many
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def portions(batch: pa.RecordBatch, text: str, limit: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most `limit` bytes of text each (a longer text stands alone)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    if not len(sizes):
        return
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins (one more than texts); null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[where[0]:where[-1]], where - where[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit words."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        grown = np.full(-(-n // POWER_STEP) * POWER_STEP, base, np.uint64)
        grown[0] = 1
        have = _powers[name] = np.cumprod(grown)
    return have[:n]


def spans_of(solid: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of True that does not cross a text bound."""
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < len(solid))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: a polynomial in an odd base read off prefix sums, then mixed."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n + 1)[:n], out=prefix[1:])
    value = (prefix[end] - prefix[begin]) * _power("down", _INVERSE, n + 1)[begin]
    return mix(value + (end - begin).astype(np.uint64) * _BASE)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of all texts, and where each text's words begin."""
    data, bounds = flat(column)
    begin, end = spans_of(~WHITE[data], bounds)
    return hash_spans(LOWER[data], begin, end), np.searchsorted(begin, bounds)
