"""What is known from earlier runs, and what to fetch again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplake.operators.lifecycle import recency
from snaplake.operators.rules import may_match_place
from snaplake.operators.upsert import publish

KEYS = ("job_key", "source", "company", "list_ref")
# The platforms that need a call for each posting, which is what the state saves.
PLATFORMS = ["workday", "oracle", "eightfold", "successfactors"]


def fetch_state(rows: DataFrame, as_of: Column, keep_days: int = 14, order: Column | None = None, platforms: Sequence[str] = PLATFORMS) -> DataFrame:
    """Latest facts of every listing of ``platforms`` seen in the last ``keep_days`` days that was fetched in full once.

    A row without a list reference can't be listed again and is left out.
    """
    order = order if order is not None else recency()
    full = ~F.col("fetch_mode").eqNullSafe("seen")
    last = lambda c: F.max_by(c, F.when(full, order)).alias(c)
    state = rows.where(F.col("source").isin(list(platforms)) & F.col("list_ref").isNotNull()).groupBy(*KEYS).agg(last("source_id"), last("title"), last("location"), last("url"), last("posted_at"), F.max("snapshot_day").alias("last_seen"), F.max(F.when(full, F.col("snapshot_day"))).alias("last_full"))
    return state.where(F.col("last_full").isNotNull() & (F.col("last_seen") >= F.date_sub(as_of, keep_days)))


def export_state(state: DataFrame, root: str, landing: str, version: str) -> str:
    """Publish the state as a JSON version below ``root``, which may not lie in the landing folder: what is landed is ingested."""
    inside = f"{root.rstrip('/')}/".startswith(f"{landing.rstrip('/')}/")
    if inside:
        raise ValueError(f"{root} lies in the landing folder {landing}")
    return publish(state, root, version, "json")


def fetch_plan(listing: DataFrame, state: DataFrame, today: Column, refresh_days: int = 7, boards: DataFrame | None = None) -> DataFrame:
    """``listing`` with ``fetch_mode``: ``seen`` if the text is young enough, else ``fetch``, and the cached facts of seen rows.

    ``boards`` (``source, company, refresh_days``) overrides the age for some boards; its size is the number of boards.
    """
    known = state.select("source", "company", "list_ref", *[F.col(c).alias(f"known_{c}") for c in ("title", "location", "url", "posted_at")], "last_full")
    rows = listing.join(known, ["source", "company", "list_ref"], "left")
    days: Column = F.lit(refresh_days)
    if boards is not None:
        rows = rows.join(boards.select("source", "company", F.col("refresh_days").alias("__days")), ["source", "company"], "left")
        days = F.coalesce("__days", days)
    young = F.coalesce(F.datediff(today, "last_full") < days, F.lit(False))
    seen = lambda c: F.when(young, F.col(f"known_{c}")).alias(c)
    return rows.select("source", "company", "list_ref", F.when(young, "seen").otherwise("fetch").alias("fetch_mode"), *[seen(c) for c in ("title", "location", "url", "posted_at")], F.lit(None).cast("string").alias("raw_text"))


def capped_list(rows: DataFrame, group: list[str], ref: str, order: Column, cap: Column) -> DataFrame:
    """The first ``cap`` distinct references of a board in listing order."""
    first = rows.groupBy(*group, ref).agg(F.min(order).alias("__order"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("__order", ref))
    return first.withColumn("rank", rank).where(F.col("rank") <= cap).drop("__order")


#: What is written down for a board: days after which a text is fetched again, most listings, whether its search is trusted, and title terms of its own.
BOARDS = "source string, company string, refresh_days int, max_jobs int, trust_search boolean, titles array<string>"


def board_listing(listing: DataFrame, boards: DataFrame, titles: Sequence[str], places: Sequence[str], order: Column, cap: int) -> DataFrame:
    """The listings that their boards' configuration lets through: ``source, company, list_ref, rank``.

    A title must hold one of the board's ``titles``, else of the common ones, unless its search is trusted; a place must match unless it
    can't be told yet.  Of what is left the first ``max_jobs`` of a board stay (else ``cap``), by ``order``.
    """
    own = boards.select("source", "company", "max_jobs", "trust_search", F.col("titles").alias("__titles"))
    rows = listing.join(own, ["source", "company"], "left")
    terms = F.coalesce("__titles", F.array(*map(F.lit, titles)).cast("array<string>"))
    named = (F.size(terms) == 0) | F.exists(terms, lambda w: F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lower(w)))
    kept = rows.where((F.coalesce("trust_search", F.lit(False)) | named) & may_match_place("location", places)).withColumns({"__order": order, "__cap": F.coalesce("max_jobs", F.lit(cap))})
    first = kept.groupBy("source", "company", "list_ref", "__cap").agg(F.min("__order").alias("__order"))
    rank = F.row_number().over(Window.partitionBy("source", "company").orderBy("__order", "list_ref"))
    return first.withColumn("rank", rank).where(F.col("rank") <= F.col("__cap")).select("source", "company", "list_ref", "rank")


def run_audit(rows: DataFrame) -> DataFrame:
    """Per board: postings, fetched in full, and reused."""
    return rows.groupBy("company", "source").agg(F.count("*").alias("postings"), F.count_if(~F.col("fetch_mode").eqNullSafe("seen")).alias("fetched_full"), F.count_if(F.col("fetch_mode") == "seen").alias("reused"))


def board_yield(rows: DataFrame, wanted: Column) -> DataFrame:
    return rows.groupBy("source").agg(F.count("*").alias("postings"), F.count_if(wanted).alias("wanted"))


def latest_per_group(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
