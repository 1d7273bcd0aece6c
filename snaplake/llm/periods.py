"""Periodic runs: stretches of words that repeat themselves three times or more, found by multi-scale minimizers.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are equal), of at least ``max(24, 3 * q)`` words, which no
neighbouring word extends.  Every run is found:

* Periods up to 8 are found by a direct scan of each lag.
* A scale covers the periods ``low < q <= high``, with ``high`` about ``1.5 * low``.  At a scale every ``high`` consecutive words are a gram, and a
  gram is a minimizer if its hash is least in some window of ``2 * (low + 1) - high + 1`` grams.  A run of ``3 * q`` words holds such a window and the same
  window ``q`` words later, so their minimizers are ``q`` apart.  As a gram is no shorter than the period, and no shorter period divides it, equal
  grams in a run are never closer than ``q``: the next equal minimizer is the one at distance ``q``.  So neighbours among equal minimizers are all the seeds that
  are needed, and there are about six of them in ``high`` words.
* A seed is extended to both sides by comparing words, in steps that double; seeds inside a stretch that was extended before are skipped.

Words are compared by 64-bit hashes of their bytes.  A stretch that several periods fit has them all with the same ends, so the least of them is the period.
Work grows with the words times the number of scales (logarithm of the longest text), memory with the longest text (some 100 bytes a word).

Cases: null text and text without words have no run and an empty collapsed text; rows are judged each on its own, repeated ones and null ids alike; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.llm import batches as B

#: A run has this many words and this many periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Periods up to this one are scanned for lag by lag; 3 * 8 = 24.
SHORT = 8
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_DDL = "struct<start: bigint, length: bigint, period: bigint>"
_LEFT, _MOST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFFFFFFFFFF)

Run = tuple[int, int, int]


def extremes(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """``op`` over every window of ``width`` values, by windows that double."""
    have = 1
    while 2 * have <= width:
        values = op(values[:-have], values[have:])
        have *= 2
    return op(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def _joined(grams: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of each gram together with the one ``apart`` words later; the last ``apart`` places hold nothing that is used."""
    out = np.zeros_like(grams)
    if apart < len(grams):
        out[: len(grams) - apart] = B.mix(grams[: len(grams) - apart] * _LEFT + grams[apart:])
    return out


def short_periods(words: np.ndarray, ends: np.ndarray) -> Iterator[Run]:
    """Stretches of at least 24 words of each period up to 8; ``ends`` is where each word's text ends."""
    place = np.arange(len(words))
    for q in range(1, min(SHORT, len(words) - 1) + 1):
        same = np.concatenate([[False], (words[:-q] == words[q:]) & (place[q:] < ends[:-q]), [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        starts, stops = edges[::2], edges[1::2]
        long = stops - starts >= LEAST_WORDS - q
        for s, e in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            yield s, e - s + q, q


def seeds(grams: np.ndarray, ends: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of neighbours among the equal minimizers of one scale; ``grams`` are hashes of ``high`` words."""
    width = 2 * (low + 1) - high + 1
    whole = np.arange(len(grams)) + high <= ends
    least = extremes(np.where(whole, grams, _MOST), width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero((extremes(np.concatenate([edge, least, edge]), width, np.maximum) == grams) & whole)
    chosen = chosen[np.argsort(grams[chosen], kind="stable")]
    a, b = chosen[:-1], chosen[1:]
    good = (grams[a] == grams[b]) & (b - a > low) & (b - a <= high) & (ends[a] == ends[b])
    return a[good], (b - a)[good]


def _first_difference(a: np.ndarray, b: np.ndarray) -> int:
    """How many values from the start are equal, looked at in steps that double."""
    at, step = 0, 64
    while at < len(a):
        unlike = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if len(unlike):
            return at + int(unlike[0])
        at, step = at + step, 2 * step
    return len(a)


def extended(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: np.ndarray, distance: np.ndarray) -> Iterator[Run]:
    """The stretch of period ``distance`` around each seed, each stretch once, if it is long enough."""
    order = np.lexsort((place, distance))
    period, upto = 0, 0
    for p, q in zip(place[order].tolist(), distance[order].tolist(), strict=True):
        if q == period and p < upto:
            continue
        first, last = int(starts[p]), int(ends[p])
        right = p + _first_difference(words[p : last - q], words[p + q : last])
        left = p - _first_difference(words[first:p][::-1], words[first + q : p + q][::-1])
        period, upto = q, right
        if right > p and right + q - left >= LEAST_PERIODS * q:
            yield left, right + q - left, q


def runs_of(words: np.ndarray, bounds: np.ndarray) -> list[list[Run]]:
    """The runs of each text, by start and then period; text ``i`` has the words ``bounds[i]:bounds[i + 1]``."""
    sizes = np.diff(bounds)
    found: dict[tuple[int, int], int] = {}

    def keep(runs: Iterator[Run], at: np.ndarray | None = None) -> None:
        for s, length, q in runs:
            key = (s if at is None else int(at[s]), length)
            found[key] = min(q, found.get(key, q))

    keep(short_periods(words, np.repeat(bounds[1:], sizes)))
    at, low, power, grams = np.arange(len(words)), SHORT, 1, words
    starts, ends = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    while True:
        wanted = ends - starts >= LEAST_PERIODS * (low + 1)  # texts that have room for three periods of this scale
        if not wanted.any():
            break
        if not wanted.all():
            moved = np.cumsum(wanted) - wanted
            size = (ends - starts)[wanted]
            at, words, grams, starts = at[wanted], words[wanted], grams[wanted], moved[starts[wanted]]
            ends = starts + size
        high = 3 * low // 2
        while 2 * power <= high:
            grams, power = _joined(grams, power), 2 * power
        keep(extended(words, starts, ends, *seeds(_joined(grams, high - power) if high > power else grams, ends, low, high)), at)
        low = high
    out: list[list[Run]] = [[] for _ in sizes]
    keys = sorted((s, q, length) for (s, length), q in found.items())
    for (s, q, length), i in zip(keys, (np.searchsorted(bounds, [k[0] for k in keys], "right") - 1).tolist(), strict=True):
        out[i].append((s - int(bounds[i]), length, q))
    return out


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period, compared as whole numbers; the first one of equals, then the shortest period."""
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    return best


def without_repeats(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words but for those that a run repeats: what stands after its first period."""
    gone = np.zeros(len(words), dtype=bool)
    for s, length, q in runs:
        gone[s + q : s + length] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_runs, collapsed = [], []
        for lo, hi, data, offsets in B.pieces(batch["text"]):
            starts, ends, rows = B.word_spans(data, offsets)
            runs = runs_of(B.span_hashes(data, starts, ends), B.row_bounds(rows, hi - lo))
            whole = data.tobytes()
            for r, a, b in zip(runs, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                words = whole[a:b].split()
                collapsed.append(b" ".join(without_repeats(words, r) if r else words).decode())
            all_runs += runs
        named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in all_runs]
        best = [None if (b := strongest(runs)) is None else dict(zip(("start", "length", "period"), b, strict=True)) for runs in all_runs]
        yield pa.record_batch([batch["doc_id"], pa.array(named, pa.list_(RUN)), pa.array(best, RUN), pa.array(collapsed, pa.string())], names=["doc_id", "runs", "strongest", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, the ``runs`` of each row's text by start and period, its ``strongest`` run, and the text ``collapsed`` to what no run repeats, joined by one space."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_runs, f"doc_id long, runs array<{RUN_DDL}>, strongest {RUN_DDL}, collapsed string")


def runs_text(runs: str) -> Column:
    """A line ``start,length,period`` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in which a tenth of the documents, by their ids, repeats a stretch of its words up to the end.

    With h = crc32 of the decimal id and g = h div 10, where 10 divides h: word i >= a becomes word a + (i - a) mod p, for a = g mod n and p = 1 + (n - a) div (3 + g mod 8).
    A null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def edited(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " "))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    changed = F.when(h % 10 == 0, F.get(F.transform(F.array(words), edited), 0))  # the lambda's argument is the text's words, cut once
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(changed, "text").alias("text"))
