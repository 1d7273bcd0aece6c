"""Quality rules: how often lines recur across the documents of a host.

A line's key is its words (A-Z lowered) joined by one space.  Per host and line the documents that hold it are counted
(a ``doc_id`` counts once however often its text or rows repeat a line; exact copies with ids of their own are documents).  A line held by more than ``limit``
documents of a host is boilerplate there, however large the host is, and is removed from every document but the host's first
(smallest ``doc_id``) that holds it.  A document that loses more than
``max_removed`` percent of its words is depleted and rejected, as is one that fails the base rules.  ``line_verdicts`` judges,
``keep_good`` selects rows as they are, ``cleaned`` also cuts the removed lines from the texts of the rows that stay.

Cases: null text has no words and fails; a null host is a host of its own; rows with the same ``doc_id`` are one document for the
counts, and judged each on its own text; rows without ``doc_id`` count each and are never the first, and a line that only they hold stays; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm import batches as B
from snaplake.storage import Scratch

#: A line may be in this many documents of a host.
LIMIT = 20
#: Percent of its words that a document may lose.
MAX_REMOVED = 70
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(words: np.ndarray) -> int:
    """Words that lie in a window of three words which occurs twice or more."""
    if len(words) < 4:
        return 0
    w = B.mix(words[:-2] * np.uint64(3) + B.mix(words[1:-1] * np.uint64(5) + B.mix(words[2:])))
    _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def measure(texts: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]]:
    """For pieces of ``texts``: the base figures of each row, and (line hash, words in such lines) of its lines."""
    for lo, hi, data, offsets in B.pieces(texts):
        n = hi - lo
        starts, ends, rows = B.word_spans(data, offsets)
        bounds = B.row_bounds(rows, n)
        hashes = B.span_hashes(data, starts, ends)
        low = B.span_hashes(B.lower_ascii(data), starts, ends)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
        chars = np.concatenate([[0], np.cumsum(lead[ends] - lead[starts])])
        out = {k: np.zeros(n, np.int64) for k in STATS}
        out["n_words"] = np.diff(bounds)
        out["word_chars"] = chars[bounds[1:]] - chars[bounds[:-1]]
        out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]
        first, last, wa, wb, line_rows = _lines(data, offsets, starts)
        whole = data.tobytes()
        place = B.run_hashes(low, wa, wb)
        lines = []
        line_bounds = B.row_bounds(line_rows, n)
        for i in range(n):
            a, b = line_bounds[i], line_bounds[i + 1]
            if b > a:
                if b > a + 1:  # by their bytes, not by a hash
                    out["n_dup_lines"][i] = b - a - len({whole[x:y] for x, y in zip(first[a:b].tolist(), last[a:b].tolist(), strict=True)})
                keys, inverse = np.unique(place[a:b], return_inverse=True)
                lines.append((keys.view(np.int64), np.bincount(inverse, weights=(wb - wa)[a:b]).astype(np.int64)))
            else:
                lines.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            out["n_repeat_words"][i] = _repeated(hashes[bounds[i] : bounds[i + 1]])
        yield lo, hi, out, lines


def _lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, first word, end word, row) of the lines that hold words: between line ends and row edges.

    A line is named by its exact bytes, or by its words alone.
    """
    cuts = np.flatnonzero(data == 10)
    first = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    line_rows = np.searchsorted(offsets[1:], first, "right")
    keep = line_rows < len(offsets) - 1
    first, line_rows = first[keep], line_rows[keep]
    last = np.minimum(np.append(cuts, len(data))[np.searchsorted(cuts, first)], offsets[1:][line_rows])
    wa, wb = np.searchsorted(starts, first), np.searchsorted(starts, last)
    full = (wb > wa) & (last > first)
    return first[full], last[full], wa[full], wb[full], line_rows[full]


def without_lines(texts: pa.Array, cut: list[np.ndarray]) -> list[str]:
    """Each text without the lines whose hash is in its ``cut``; other lines, blank ones too, stay as they are."""
    out = []
    for lo, hi, data, offsets in B.pieces(texts):
        starts, ends, _ = B.word_spans(data, offsets)
        first, last, wa, wb, line_rows = _lines(data, offsets, starts)
        place = B.run_hashes(B.span_hashes(B.lower_ascii(data), starts, ends), wa, wb).view(np.int64)
        bounds = B.row_bounds(line_rows, hi - lo)
        for i in range(hi - lo):
            a, b = bounds[i], bounds[i + 1]
            gone = set(first[a:b][np.isin(place[a:b], cut[lo + i])].tolist())
            at, parts = int(offsets[i]), []
            for line in data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n"):
                if at not in gone:
                    parts.append(line)
                at += len(line) + 1
            out.append(b"\n".join(parts).decode())
    return out


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())]))
    for batch in batches:
        parts = list(measure(batch["text"]))
        figures = {k: np.concatenate([p[2][k] for p in parts]) if parts else np.zeros(0, np.int64) for k in STATS}
        lines = [x for p in parts for x in p[3]]
        at = np.concatenate([[0], np.cumsum([len(x[0]) for x in lines])]).astype(np.int32)
        h, w = (np.concatenate([x[k] for x in lines]) if lines else np.zeros(0, np.int64) for k in (0, 1))
        lists = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(h, pa.int64()), pa.array(w, pa.int64())], ["h", "w"]))
        yield pa.record_batch([batch["row"], *(pa.array(figures[k], pa.int64()) for k in STATS), lists.cast(kind)], names=["row", *STATS, "lines"])


def line_verdicts(docs: DataFrame, host: str = "source", limit: int = LIMIT, max_removed: int = MAX_REMOVED, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id``, the base figures, ``base_failed``, ``kept``, ``removed_words`` and the hashes ``cut`` of the removed lines of every row of ``docs``.

    One pass over the texts; everything after it works on line hashes.  Counts by (host, line) are combined before the
    shuffle, so a hot line is never one task's work, and the join back is one that Spark can split.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("")).alias("host"), "text")
    keyed = rows.withColumn("row", F.struct("doc_id", "host", F.xxhash64("text").alias("digest")))
    profile = keyed.select("row", "text").mapInArrow(_profile, f"row struct<doc_id: long, host: string, digest: long>, {', '.join(k + ' long' for k in STATS)}, lines array<struct<h: long, w: long>>")
    profile = scratch.stored(profile.select(F.monotonically_increasing_id().alias("row_id"), "row.*", *STATS, "lines"), "quality-lines")
    lines = profile.select("row_id", "doc_id", "host", F.explode("lines").alias("line")).select("row_id", "doc_id", "host", "line.*")
    over = lines.groupBy("host", "h").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first")).where(F.col("documents") > limit)
    # rows of one document count once: what repeated rows add to a line is taken off again
    repeated = profile.where("doc_id IS NOT NULL").groupBy("doc_id", "host").count().where("count > 1").select("doc_id", "host")
    again = lines.join(repeated, ["doc_id", "host"], "left_semi").groupBy("host", "h", "doc_id").agg((F.count("*") - 1).alias("more")).where("more > 0")
    extra = again.groupBy("host", "h").agg(F.sum("more").alias("more"))
    over = over.join(extra, ["host", "h"], "left").where(F.col("documents") - F.coalesce("more", F.lit(0)) > limit).select("host", "h", "first")
    hits = lines.join(over, ["host", "h"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    removed = hits.groupBy("row_id").agg(F.sum("w").alias("removed_words"), F.collect_list("h").alias("cut"))
    judged = profile.drop("lines").join(removed, "row_id", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    kept = ~failed & (100 * F.col("removed_words") <= max_removed * F.col("n_words"))
    return judged.select("doc_id", "host", "digest", *STATS, failed.alias("base_failed"), kept.alias("kept"), "removed_words", "cut")


def keep_good(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Rows are matched by ``doc_id``, host and text digest; equal rows share a verdict, so none is lost or doubled.
    """
    rejected = line_verdicts(docs, host, **limits).where(~F.col("kept")).select("doc_id", "host", "digest").distinct()
    a, b = docs.alias("a"), rejected.alias("b")
    return a.join(b, _same_row(host), "left_anti")


def _same_row(host: str) -> F.Column:
    """Rows ``a`` of the documents and ``b`` of the verdicts."""
    return F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.coalesce(F.concat(F.lit("h"), F.col(f"a.{host}")), F.lit("")) == F.col("b.host")) & (F.xxhash64("a.text") == F.col("b.digest"))


def _cut(names: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, texts = batch[-1], batch[names.index("text")]
            hit = np.flatnonzero(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False) > 0)
            if len(hit):
                out = texts.to_pylist()
                for i, text in zip(hit.tolist(), without_lines(texts.take(pa.array(hit)), [np.array(lists[i].as_py(), np.int64) for i in hit.tolist()]), strict=True):
                    out[i] = text
                texts = pa.array(out, texts.type)
            yield pa.record_batch([texts if name == "text" else batch[k] for k, name in enumerate(names)], names=names)

    return cut


def cleaned(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns and without the removed lines in ``text``.

    Only rows that are rejected or lose lines are on the other side of the join, which has one row for equal rows.
    """
    changed = line_verdicts(docs, host, **limits).where(~F.col("kept") | F.col("cut").isNotNull()).groupBy("doc_id", "host", "digest").agg(F.first("kept").alias("kept"), F.first("cut").alias("cut"))
    a, b = docs.alias("a"), changed.alias("b")
    stay = a.join(b, _same_row(host), "left").where(F.col("b.kept").isNull() | F.col("b.kept"))
    return stay.select("a.*", F.col("b.cut").alias(B.unused(docs.columns, "__cut"))).mapInArrow(_cut(docs.columns), docs.schema)
