"""Mixing sources to target weights by entropy balancing.

Document rates ``r`` stay as close to 1 as possible in relative entropy while each source meets its constraint: its words
times rates must equal its target.  The convex dual has the solution ``r = min(2, exp(b_s * z))`` with ``z`` a document's size over
its source's mean, so a source that must grow takes more of its long documents and one that must shrink fewer.  (A constraint on the
number of documents by the same ratio would make every rate of a source the same.)  Newton's method on the logarithm of the words finds ``b_s``: each step
is one distributed sum over the histogram of (source, size), then a division for each source; a step that leaves the bracket
of the root is replaced by its middle.  Sources are rows of tables throughout, so there may be millions (hosts, say).  Rates are rounded into copies by carrying the rounding error in words from document to document, from long
to short, in blocks of bounded size, so each block's error ends below half of its shortest document.

Cases: null text has no words and is never taken; a null source is a source of its own, ordered last; equal rows get equal
copies; sizes of 0 get a rate but no words; empty tables give empty results; other columns are ignored or passed through.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm import batches as B
from snaplake.storage import Scratch, stored

#: Weights of sources in order, repeating; total of the mix over the total of sizes; most copies of a document.
WEIGHTS, TOTAL, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Documents rounded in one group.
BLOCK = 4096
#: Most passes over the histogram; the tilt of a source of which nothing is taken.
STEPS, NONE = 100, -1e9


def word_count(text) -> F.Column:
    """Runs of characters other than space and \\t..\\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source) -> F.Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def ranked(totals: DataFrame, scratch: Scratch) -> DataFrame:
    """``totals`` with the ``place`` of each source by code point, null last: an ordered table, whose partitions are counted."""
    ordered = totals.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id())
    ordered = scratch.stored(ordered, "mix-order")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, starts = 0, []
    for r in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each partition of the sort
        starts += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    return ordered.withColumn("place", (F.element_at(F.create_map(*starts), part) if starts else F.lit(0)) + within).drop("at")


def targets(totals: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, scratch: Scratch | None = None) -> DataFrame:
    """``source, source_size, target`` and the other columns of ``totals``, a row for each source.

    A source's target is ``level * weight``, but at most ``most`` times its size.  Excess is shared again by weight: the level rises
    until no more sources are full.  The driver holds the level and a few sums, whatever the number of sources.
    """
    scratch = scratch or Scratch(totals.sparkSession)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = scratch.stored(ranked(totals, scratch).withColumn("weight", weight), "mix-weights")
    level, full = None, 0
    cap = most * F.col("source_size")
    while True:
        is_full = F.lit(False) if level is None else level * F.col("weight") > cap
        sums = rows.agg(F.sum("source_size").alias("size"), F.sum(F.when(is_full, cap).otherwise(0.0)).alias("used"), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))).alias("open"), F.count_if(is_full).alias("full")).first()
        if level is not None and sums["full"] == full or not sums["open"]:
            break
        level, full = (total * sums["size"] - sums["used"]) / sums["open"], sums["full"]
    target = F.when(level * F.col("weight") > cap, cap).otherwise(level * F.col("weight")) if level is not None else cap
    return rows.withColumn("target", target.cast("double")).drop("place", "weight")


def balance(histogram: DataFrame, goals: DataFrame, steps: int = STEPS, most: float = MOST, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``goals`` with ``n, mean`` and the ``b`` that solves the dual.

    ``histogram``: ``source, size, docs``; ``goals``: ``source, source_size, target``, a row per source.  The state of all sources is
    a table.  A step joins it with the histogram for the words taken and their derivative, and moves every ``b`` in columns.  Words taken
    grow with ``b``, so each sum also narrows a bracket of the root.  It ends when every source meets its target to a part in 10**9; a
    target that only rates of ``most`` meet has the root where the shortest document with words reaches the cap.  If a
    source has not got there after ``steps``, that is an error.
    """
    scratch, rounds = scratch or Scratch(histogram.sparkSession), Scratch(histogram.sparkSession)
    size, b, ratio = F.col("size"), F.col("b"), F.col("ratio")
    histogram = histogram.withColumn("of", _key(F.col("source")))
    seen = histogram.groupBy("of").agg(F.sum("docs").alias("n"), F.sum(F.col("docs") * size).alias("words"), F.min(F.when(size > 0, size)).alias("least"))
    state = goals.withColumn("key", _key(F.col("source"))).join(seen, F.col("key") == F.col("of")).drop("of")
    some = F.col("words") > 0
    infinite = F.lit(math.inf)
    state = (
        state.withColumn("mean", F.when(some, F.col("words") / F.col("n")).otherwise(1e-9))
        .withColumn("ratio", F.when(some, F.col("target") / F.nullif("words", F.lit(0))).otherwise(1.0))
        .withColumn("high", F.when(some, math.log(most) * F.col("mean") / F.col("least") * (1 + 1e-9)).otherwise(0.0))
        .withColumn("at_cap", some & (ratio >= most * (1 - 1e-9)))
        .withColumn("b", F.when(F.col("at_cap"), F.col("high")).when(some & (ratio <= 0), NONE).otherwise(0.0))
        .withColumn("low", -infinite)
        .withColumn("done", ~some | F.col("at_cap") | (ratio <= 0))
        .drop("at_cap", "least", "words")
    )
    state = rounds.stored(state, "mix-state")
    for _ in range(steps):
        if state.where("NOT done").isEmpty():
            break
        z, rate = size / F.col("mean"), tilted(most)
        now = histogram.join(state.where("NOT done").select("key", "b", "mean"), F.col("of") == F.col("key"))
        sums = now.groupBy("of").agg(F.sum(rate * z * F.col("docs")).alias("g"), F.sum(F.when(rate < most, rate * z * z * F.col("docs")).otherwise(0.0)).alias("h"))
        want = ratio * F.col("n")
        got = state.join(sums, F.col("key") == F.col("of"), "left").withColumn("want", want)
        got = got.withColumn("low", F.when(F.col("g") < F.col("want"), b).otherwise(F.col("low"))).withColumn("high", F.when(F.col("g") >= F.col("want"), b).otherwise(F.col("high")))
        low, high = F.col("low"), F.col("high")
        newton = b - F.ln(F.nullif(F.col("g"), F.lit(0.0)) / F.col("want")) * F.col("g") / F.nullif(F.col("h"), F.lit(0.0))
        middle = F.when(low == -infinite, 2 * b - 1).when(low > 0, F.sqrt(low * high)).otherwise((low + high) / 2)
        met = F.abs(F.col("g") - F.col("want")) < 1e-9 * F.col("want")
        got = got.withColumn("next", F.when((newton > low) & (newton < high), newton).otherwise(middle))
        got = got.withColumn("b", F.when(F.col("done") | met, b).otherwise(F.col("next"))).withColumn("done", F.col("done") | F.coalesce(met, F.lit(False)))
        state = rounds.stored(got.select(*state.columns), "mix-state")
        rounds.drop(keep=1)
    if (left := state.where("NOT done").count()) > 0:
        raise RuntimeError(f"{left} sources are off their targets after {steps} steps")
    # sums may differ in their last bits from run to run; the tilt does not
    out = scratch.stored(state.select(*goals.columns, "n", "mean", F.round("b", 10).alias("b")), "mix-tilt")
    rounds.drop()
    return out


def tilted(most: float = MOST) -> F.Column:
    """A document's rate under the tilt of its source."""
    return F.least(F.lit(most), F.exp(F.col("b") * F.col("size") / F.col("mean")))


def _rounded(most: float):
    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "key", "doc_id"], ascending=[False, True, True], kind="stable")
        carry, copies = 0.0, []
        for size, rows, rate in zip(group["size"].to_numpy(), group["rows"].to_numpy(), group["rate"].to_numpy(), strict=True):
            words = size * rows
            want = rate * words + carry
            k = int(min(most, max(0, round(want / words)))) if words else 0
            carry = want - k * words
            copies.append(k)
        return group.assign(copies=copies)[[*PLAN, "copies"]]

    return one


PLAN = ["doc_id", "source", "key", "size", "rows", "source_size", "target", "rate"]


def plan(docs: DataFrame, text: str = "text", source: str = "source", weights=WEIGHTS, total: float = TOTAL, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """``doc_id, source, key, size, rows, source_size, target, rate, copies``: a row for each distinct document, written.

    The texts are read once for their word counts.  A hot source has as many blocks as its documents need, dealt by hash.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64("doc_id", text).alias("key"))
    scratch = Scratch(docs.sparkSession)
    sizes = scratch.stored(sizes.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("rows")), "mix-sizes")
    histogram = scratch.stored(sizes.groupBy("source", "size").agg(F.sum("rows").alias("docs")), "mix-histogram")
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    tilt = balance(histogram, targets(totals, weights, total, most, scratch), most=most, scratch=scratch)
    per = tilt.select(_key(F.col("source")).alias("s"), "source_size", "target", "b", "mean", F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("long").alias("blocks"))
    rated = sizes.join(per, _key(F.col("source")) == F.col("s")).withColumn("rate", F.round(tilted(most), 9))
    dealt = rated.select(*PLAN, F.pmod(F.xxhash64("key"), "blocks").alias("block"))
    kinds = "doc_id long, source string, key long, size long, rows long, source_size long, target double, rate double, copies long"
    done = stored(dealt.groupBy("source", "block").applyInPandas(_rounded(most), kinds), "mix-plan")
    scratch.drop()
    return done


def mix(docs: DataFrame, **options) -> DataFrame:
    """:func:`plan` with a row for each row of ``docs``, and the words ``taken`` of it."""
    rows = plan(docs, **options).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return rows.drop("row", "rows").withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, all columns kept."""
    text, source = options.get("text", "text"), options.get("source", "source")
    a, b = docs.alias("a"), plan(docs, **options).where("copies > 0").alias("b")
    same = F.col("a.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")) & F.col(f"a.{source}").cast("string").eqNullSafe(F.col("b.source")) & (F.xxhash64("a.doc_id", f"a.{text}") == F.col("b.key"))
    return a.join(b, same).withColumn(B.unused(docs.columns, "__copy"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("b.copies")))).select("a.*")
