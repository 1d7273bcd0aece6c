"""Arrow batches cut into pieces of bounded size, and word positions and hashes of a piece in numpy.

A word is a run of bytes other than space and ``\\t``..``\\r``.  UTF-8 keeps these bytes out of longer characters, so
byte positions and code point positions give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in one numpy piece.  A longer text is a piece of its own.
PIECE_BYTES = 1 << 20

SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets from 0) for runs of rows that hold at most ``limit`` bytes of text.

    Null texts count as empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row of each word) of the words in ``data``; words do not cross rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~SPACES[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, ~inside[:-1]
    after[-1], after[:-1] = True, ~inside[1:]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit of 64-bit integers over every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs ``values[start:end]``; runs may not overlap.

    Every value is mixed with its place in the run before the sum, so no algebra of powers makes different runs collide.
    """
    size = ends - starts
    upto = np.cumsum(size)
    first = upto - size
    total = int(upto[-1]) if len(upto) else 0
    place = np.arange(total, dtype=np.int64)
    at = place + np.repeat(starts - first, size)
    place -= np.repeat(first, size)
    h = values[at] ^ (place.view(np.uint64) * _PLACE)
    h *= _SPREAD
    h ^= h >> np.uint64(32)
    h *= _SPREAD
    h ^= h >> np.uint64(29)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
    return mix(sums[upto] - sums[first] + size.astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, which may not overlap, equal wherever the bytes are equal."""
    return run_hashes(_BYTE_CODES[data], starts, ends)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return LOWER[data]


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` rows begins in the sorted ``rows``, and the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def unused(columns: list[str], name: str) -> str:
    """``name``, with more underscores where a column is called that already (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
