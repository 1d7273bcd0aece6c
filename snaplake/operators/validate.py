"""Checks of generated texts against their sources; what fails falls back to the verified text."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplake.functions.text import grams, inflated, numbers, squeezed, tidy, vocabulary_of

MAX_BULLET, MAX_HEADLINE = 260, 110
# Words of rank.
RANKS = ["senior", "sr", "lead", "principal", "staff", "manager", "head", "architect", "director"]


def _problem(name: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(name + " "), F.array_join(F.array_sort(values), ", ")))


def problems(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _new_facts(rows: DataFrame, key: str, text: str, source: str, tools: Mapping[str, str] | DataFrame, tags: str | None, lowered: Callable[[str], Column]) -> DataFrame:
    """``key, numbers, tools``: sorted lists of what a text has and its source (or its tags) has not; no row for a text with nothing new.

    Runs of words of both texts meet the vocabulary in one join; what stands in both is told apart by aggregation.
    """
    known, sizes = vocabulary_of(rows.sparkSession, tools)
    part = lambda kind, own, c: F.struct(F.lit(kind).alias("kind"), F.lit(own).alias("own"), F.col(c).alias("text"))
    parts = rows.select(key, F.explode(F.array(*[part(kind, own, c) for kind in ("word", "number") for own, c in ((True, text), (False, source))])).alias("p")).select(key, "p.*")
    facts = parts.select(key, "kind", "own", F.explode(F.when(F.col("kind") == "word", grams("text", sizes, lowered)).otherwise(numbers("text"))).alias("term"))
    if tags is not None:
        facts = facts.unionByName(rows.select(key, F.lit("tag").alias("kind"), F.lit(False).alias("own"), F.explode(tags).alias("term")).withColumn("term", tidy("term")))
    facts = facts.join(known.withColumnRenamed("term", "__term"), (F.col("kind") != "number") & (F.col("term") == F.col("__term")), "left")
    facts = facts.where((F.col("kind") != "word") | F.col("name").isNotNull()).withColumn("name", F.coalesce("name", "term"))
    number = F.col("kind") == "number"
    new = facts.groupBy(key, number.alias("number"), "name").agg(F.bool_and("own").alias("new")).where("new")
    return new.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("number"), F.col("name")))).alias("__numbers"), F.sort_array(F.collect_list(F.when(~F.col("number"), F.col("name")))).alias("__tools"))


def check_texts(rows: DataFrame, text: str, source: str, tools: Mapping[str, str] | DataFrame, most: int = MAX_BULLET, tags: str | None = None, key: str | None = None, lowered: Callable[[str], Column] = squeezed) -> DataFrame:
    """``rows`` with ``problems`` and ``final``: a text with new numbers or tools, without content or too long gives way to its source.

    ``tools`` maps spellings, of one word or several, to names (or is a table of ``term, name``).  Tools that the source mentions or that are listed in its ``tags`` (a
    column of arrays) are not new.  A row whose source is null names an unknown source and has no final text.  Rows are told apart
    by a digest of what is checked, so that equal or null keys don't mix; ``key``, a column that differs between most rows, spreads equal texts.  ``lowered`` is how a
    text is read when tools are looked for.
    """
    none = F.lit("")
    told = F.sha2(F.to_json(F.struct(*([key] if key else []), F.coalesce(text, none).alias("__t"), F.coalesce(source, none).alias("__s"), *([tags] if tags else []))), 256)
    rows = rows.withColumns({"__key": told, "__t": F.btrim(F.coalesce(text, none)), "__s": F.coalesce(source, none)})
    facts = _new_facts(rows, "__key", "__t", "__s", tools, tags, lowered)
    rows = rows.join(facts, "__key", "left")
    found = problems(
        F.when(F.col(source).isNull(), F.lit("unknown source")),
        F.when(F.col("__t") == "", F.lit("empty text")),
        _problem("new numbers", F.col("__numbers")),
        _problem("new tools", F.col("__tools")),
        F.when(F.length("__t") > most, F.lit("too long")),
    )
    rows = rows.withColumn("problems", found)
    return rows.withColumn("final", F.when(F.size("problems") > 0, F.col(source)).otherwise(F.col("__t"))).drop("__key", "__t", "__s", "__numbers", "__tools")


def check_headlines(rows: DataFrame, headline: str, titles: str, most: int = MAX_HEADLINE) -> DataFrame:
    """A headline may not claim a rank that no real title has, nor be empty or too long; else the titles stand."""
    found = problems(F.when(F.btrim(F.coalesce(headline, F.lit(""))) == "", F.lit("empty")), _problem("inflated title", inflated(F.coalesce(headline, F.lit("")), F.coalesce(titles, F.lit("")), RANKS)), F.when(F.length(headline) > most, F.lit("too long")))
    rows = rows.withColumn("problems", found)
    return rows.withColumn("final", F.when(F.size("problems") > 0, F.col(titles)).otherwise(F.col(headline)))


def violations(checked: DataFrame, key: str) -> DataFrame:
    """A row for each problem, for the log."""
    return checked.select(key, F.explode("problems").alias("problem"))


def fill_to_min(proposed: DataFrame, defaults: DataFrame, group: str, item: str, order: str, least: Column, most: Column) -> DataFrame:
    """At most ``most`` proposed items of a group; if fewer than ``least``, defaults fill up in their order."""
    own = proposed.groupBy(group, item).agg(F.min(order).alias("o")).withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy("o", item))).where(F.col("r") <= most).select(group, item, F.lit(0).alias("rank"), "r")
    more = defaults.groupBy(group, item).agg(F.min(order).alias("r")).select(group, item, F.lit(1).alias("rank"), "r").join(proposed.select(group, item).distinct(), [group, item], "left_anti")
    both = own.unionByName(more).withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy("rank", "r", item)))
    return both.where((F.col("rank") == 0) | (F.col("n") <= least)).select(group, item, "n", (F.col("rank") == 1).alias("filled"))
