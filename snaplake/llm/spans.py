"""Span lists: how secret scans and personal data name what they found."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
SPAN_DDL = "struct<kind: string, start: int, end: int>"


def ordered(spans: list[tuple[str, int, int]], kinds: list[str]) -> list[tuple[str, int, int]]:
    """By start, then kind as listed in ``kinds``, then end."""
    place = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], place[s[0]], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


class Taken:
    """Spans to keep clear of, in any order; a question costs a binary search."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        by_start = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in by_start]
        self.tops = list(accumulate((b for _, b in by_start), max))

    def clear(self, start: int, end: int) -> bool:
        """Whether a span overlaps none of them."""
        i = bisect_left(self.starts, end)
        return i == 0 or self.tops[i - 1] <= start
