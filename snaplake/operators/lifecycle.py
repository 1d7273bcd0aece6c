"""One row per key from repeated snapshots: latest version, lifetime, open or closed, quality flags.

The latest row is the one loaded last; ties (rows of one load) fall to the later day and then to ``tiebreak``, so all attributes
come from one row.  A null in the latest row wins: it is the latest version.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

ATTRIBUTES = ("source", "company", "title", "location", "url")


def recency(loaded: str = "loaded_at", day: str = "snapshot_day", tiebreak: str = "seq") -> Column:
    return F.struct(loaded, day, tiebreak)


def latest_version(rows: DataFrame, key: str = "job_key", attributes: Sequence[str] = ATTRIBUTES, order: Column | None = None) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*attributes), order if order is not None else recency()).alias("v")).select(key, "v.*")


def lifetime(rows: DataFrame, key: str = "job_key", day: str = "snapshot_day") -> DataFrame:
    return rows.groupBy(key).agg(F.min(day).alias("first_seen"), F.max(day).alias("last_seen"), F.count_distinct(day).alias("days_seen"))


def latest_full(rows: DataFrame, key: str = "job_key", attributes: Sequence[str] = ("raw_text", "posted_at"), order: Column | None = None) -> DataFrame:
    """Latest full record: rows that only say "still there" never overwrite a text."""
    full = ~F.col("fetch_mode").eqNullSafe("seen")
    picked = F.max_by(F.struct(*attributes), order if order is not None else recency())
    return rows.where(full).groupBy(key).agg(picked.alias("v"), F.max("snapshot_day").alias("last_full_fetch")).select(key, "v.*", "last_full_fetch")


def latest_board_day(rows: DataFrame) -> DataFrame:
    """One row: the newest day that any board delivered.  Manual rows don't count, or one would close all boards."""
    return rows.where("source <> 'manual'").agg(F.max("snapshot_day").alias("board_day"))


def is_open() -> Column:
    return (F.col("source") == "manual") | (F.col("last_seen") >= F.col("board_day"))


@dataclass(frozen=True)
class Rule:
    """A named condition that marks a row as bad."""

    name: str
    broken: Column


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def error_rules(min_chars: int = 200, chars: Column | None = None) -> list[Rule]:
    """``chars`` is the length of the text, by default of ``raw_text``."""
    chars = chars if chars is not None else F.length("raw_text")
    return [
        Rule("missing_title", blank("title")),
        Rule("missing_company", blank("company")),
        Rule("short_description", chars.isNull() | (chars < min_chars)),
    ]


def warning_rules() -> list[Rule]:
    # an empty or null address is not an invalid one
    return [Rule("invalid_url", F.col("url").isNotNull() & (F.col("url") != "") & ~F.col("url").rlike("^https?://")), Rule("missing_location", blank("location"))]


def flags(rules: Sequence[Rule]) -> Column:
    """Names of the rules a row breaks, in the order given."""
    return F.filter(F.array(*[F.when(r.broken, F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def summary(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """What is known of each posting from ``rows``, in a form that :func:`merged` can put together with what other rows say.

    One aggregate, so one shuffle by key: the latest attributes and the latest full version each with their place in the order, the days (one value
    each), and the last day on a board.
    """
    order = order if order is not None else recency()
    full = ~F.col("fetch_mode").eqNullSafe("seen")
    text = F.struct(F.length("raw_text").alias("text_chars"), "posted_at", order.alias("text_version"))
    return rows.groupBy("job_key").agg(
        F.max_by(F.struct(F.struct(*ATTRIBUTES).alias("v"), order.alias("version")), order).alias("latest"),
        F.max_by(text, F.when(full, order)).alias("f"),
        F.min("snapshot_day").alias("first_seen"),
        F.max("snapshot_day").alias("last_seen"),
        F.collect_set("snapshot_day").alias("days"),
        F.max(F.when(full, F.col("snapshot_day"))).alias("last_full_fetch"),
        F.max(F.when(F.col("source") != "manual", F.col("snapshot_day"))).alias("board_day"),
    )


def merged(state: DataFrame, more: DataFrame) -> DataFrame:
    """Two summaries as the summary of all their rows, whichever came first."""
    both = state.unionByName(more)
    return both.groupBy("job_key").agg(
        F.max_by("latest", "latest.version").alias("latest"),
        F.max_by("f", "f.text_version").alias("f"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.array_distinct(F.flatten(F.collect_list("days"))).alias("days"),
        F.max("last_full_fetch").alias("last_full_fetch"),
        F.max("board_day").alias("board_day"),
    )


def from_summary(one: DataFrame, board: DataFrame | None = None) -> DataFrame:
    """Postings with state and flags; ``board`` is the one row of the latest day on a board, by default the summary's."""
    board = board if board is not None else one.agg(F.max("board_day").alias("board_day"))
    wide = one.drop("board_day").crossJoin(F.broadcast(board)).select("job_key", "latest.v.*", "first_seen", "last_seen", F.size("days").cast("long").alias("days_seen"), "f.text_chars", "f.text_version", F.left("f.posted_at", F.lit(10)).try_cast("date").alias("posted_date"), "last_full_fetch", "board_day")
    wide = wide.withColumn("is_open", is_open()).drop("board_day")
    return wide.withColumns({"dq_errors": flags(error_rules(chars=F.col("text_chars"))), "dq_warnings": flags(warning_rules())})


def postings(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per posting with lifetime, state, the length and version of the latest text, and flags.

    One shuffle by key gives everything.  Texts stay where they are; :func:`with_texts` fetches those of the rows that are shown.
    """
    return from_summary(summary(rows, order), latest_board_day(rows))


def with_texts(found: DataFrame, rows: DataFrame, order: Column | None = None) -> DataFrame:
    """Postings with ``raw_text`` in place of ``text_version``: one text of each posting is moved, whatever the days it was seen.

    Rows that agree in the whole order can't be told apart; of these the greatest text counts.
    """
    order = order if order is not None else recency()
    full = rows.where(~F.col("fetch_mode").eqNullSafe("seen") & F.col("raw_text").isNotNull()).select(F.col("job_key").alias("__key"), order.alias("__version"), "raw_text")
    wanted = found.where("text_chars IS NOT NULL").select("job_key", "text_version")
    texts = full.join(wanted, (F.col("__key") == F.col("job_key")) & (F.col("__version") == F.col("text_version")), "left_semi").groupBy("__key").agg(F.max("raw_text").alias("raw_text"))
    return found.join(texts, F.col("job_key") == F.col("__key"), "left").drop("__key", "text_version")


def clean(all_postings: DataFrame) -> DataFrame:
    return all_postings.where(F.size("dq_errors") == 0)


def quarantine(all_postings: DataFrame) -> DataFrame:
    """What :func:`clean` leaves out, and why."""
    return all_postings.where(F.size("dq_errors") > 0).select("job_key", "source", "company", "title", "url", "first_seen", "last_seen", F.array_join("dq_errors", ", ").alias("reason"), "dq_errors")


def daily_activity(rows: DataFrame, good: DataFrame) -> DataFrame:
    """Open and new postings per day and company, by the company named that day; manual rows have no days.

    A posting on a day is one row before it is counted, so the counts are sums; only keys and days are read.
    """
    seen = rows.where("source <> 'manual'").select("snapshot_day", "company", "job_key").distinct()
    met = seen.join(good.select("job_key", "first_seen"), "job_key")
    return met.groupBy("snapshot_day", "company").agg(F.count("*").alias("open_postings"), F.count_if(F.col("first_seen") == F.col("snapshot_day")).alias("new_postings"))


def expectation_counts(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Failures per rule in one pass: ``rule, failed, total``.  A condition that is null counts as kept."""
    one = rows.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(r.broken, F.lit(False))).alias(r.name) for r in rules])
    pairs = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(r.name).alias("failed")) for r in rules])
    return one.select("total", F.explode(pairs).alias("x")).select("x.rule", "x.failed", "total")


def observed(rows: DataFrame, warn: Sequence[Rule], drop: Sequence[Rule] = ()) -> tuple[DataFrame, Observation]:
    """``rows`` to write, without those that break a rule of ``drop``, and what the write will have seen: ``total`` and the failures of every rule.

    The counts come from the write's own pass over the rows.  A condition that is null counts as kept.
    """
    seen = Observation()
    counts = [F.count_if(F.coalesce(r.broken, F.lit(False))).alias(r.name) for r in (*warn, *drop)]
    return drop_failing(rows.observe(seen, F.count("*").alias("total"), *counts), drop), seen


def drop_failing(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that break no rule; a condition that is null keeps the row."""
    for r in rules:
        rows = rows.where(~F.coalesce(r.broken, F.lit(False)))
    return rows
