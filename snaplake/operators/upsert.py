"""Keyed changes to plain tables: every function returns the new version of the target.

Write the result to a new path and publish that (:func:`publish`); never overwrite what is being read.
Changes must have one row per key, or the write fails; :func:`one_per_key` picks the newest.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F


def one_per_key(changes: DataFrame, key: str, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return changes.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def assert_unique(changes: DataFrame, key: str) -> DataFrame:
    """``changes``; where a key repeats, the job that reads them fails and names it.

    The count is dealt by the key, as the join that follows is, so it costs no shuffle of its own.
    """
    n = F.count("*").over(Window.partitionBy(key))
    once = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"{key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(" occurs more than once"))).cast("boolean")).otherwise(True)
    return changes.withColumn("__n", n).where(once).drop("__n")


def upsert_all(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changed rows replace, new rows join."""
    changes = assert_unique(changes, key)
    return target.join(changes.select(key), key, "left_anti").unionByName(changes)


def insert_new(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """New keys join once; known keys stay as they are."""
    return target.unionByName(changes.dropDuplicates([key]).join(target.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert_guarded(target: DataFrame, changes: DataFrame, key: str, guard: Column, update: list[str], insert: Mapping[str, Column] | None = None, inserts: bool = True) -> DataFrame:
    """Update ``update`` columns where ``guard`` holds for the old row; insert new keys, with ``insert`` values for columns that changes lack.

    ``guard`` reads the target's columns.  Without ``inserts`` new keys are left out.
    """
    old = target.withColumn("__allowed", guard).withColumn("__old", F.lit(True))
    new = assert_unique(changes, key).select(F.col(key), *[F.col(c).alias(f"__new_{c}") for c in changes.columns if c != key], F.lit(True).alias("__new"))
    both = old.join(new, key, "full" if inserts else "left")
    insert = insert or {}

    def value(c: str) -> Column:
        given = F.col(f"__new_{c}") if c in changes.columns else insert.get(c, F.lit(None).cast(target.schema[c].dataType))
        kept = F.when(F.col("__allowed") & F.col("__new"), F.col(f"__new_{c}")).otherwise(F.col(c)) if c in update else F.col(c)
        return F.when(F.col("__old"), kept).otherwise(given).alias(c)

    return both.select(*[F.col(key) if c == key else value(c) for c in target.columns])


def update_matching(target: DataFrame, changes: DataFrame, on: Column, order: list[Column], guard: Column, values: Mapping[str, str]) -> DataFrame:
    """Update where a normalised key ``on`` (a column of both sides) meets; of several changes the first by ``order`` counts.

    ``values`` maps a target column to the change's column.
    """
    pick = one_per_key(changes.withColumn("__on", on).where(F.col("__on").isNotNull()), "__on", *order).select("__on", *[F.col(v).alias(f"__{k}") for k, v in values.items()], F.lit(True).alias("__hit"))
    met = target.withColumn("__on", F.when(guard, on)).join(pick, "__on", "left")
    return met.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def transition(target: DataFrame, changes: DataFrame, key: str, now: Column, final: str = "APPLIED") -> DataFrame:
    """Apply status changes: a missing note keeps the old one, and the time of ``final`` is set once."""
    new = assert_unique(changes, key).select(key, F.col("status").alias("__status"), F.col("note").alias("__note"))
    met = target.join(new, key, "left")
    first = (F.col("__status") == final) & F.col("applied_at").isNull()
    columns = {"status": F.coalesce("__status", "status"), "note": F.coalesce("__note", "note"), "applied_at": F.when(first, now).otherwise(F.col("applied_at"))}
    return met.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in target.columns])


def ensure_columns(spark: SparkSession, name: str, columns: Mapping[str, str]) -> list[str]:
    """Create a table or add the columns that it lacks, by name whatever the case; types never change.  Returns what was added."""
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({', '.join(f'`{c}` {t}' for c, t in columns.items())}) USING parquet")
        return list(columns)
    have = {c.lower() for c in spark.table(name).columns}
    missing = [c for c in columns if c.lower() not in have]
    if missing:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{c}` {columns[c]}' for c in missing)})")
    return missing


def overwrite_by_name(rows: DataFrame, name: str) -> None:
    """Replace a table's rows; ``insertInto`` goes by position, so columns are put in the table's order first."""
    rows.select(*rows.sparkSession.table(name).columns).write.mode("overwrite").insertInto(name)


def append_log(rows: DataFrame, name: str) -> None:
    rows.write.mode("append").saveAsTable(name)


POINTER = "seq long, version string, form string"


def publish(rows: DataFrame, root: str, version: str, form: str = "parquet") -> str:
    """Write a version beside the others, then point to it.

    The pointer is a log of one-row files, numbered in the order of publication, and is written after the version is whole, so a
    reader sees the old or the new.  One writer publishes at a time.
    """
    root = root.rstrip("/")
    path = f"{root}/versions/{version}"
    rows.write.mode("errorifexists").format(form).save(path)
    _point(rows.sparkSession, root, version, form)
    return path


def publish_set(results: Mapping[str, DataFrame], root: str, version: str, form: str = "parquet") -> dict[str, str]:
    """Write several results as one version: the pointer moves once, when all are whole, so no reader mixes versions."""
    root = root.rstrip("/")
    paths = {name: f"{root}/versions/{version}/{name}" for name in results}
    for name, rows in results.items():
        rows.write.mode("errorifexists").format(form).save(paths[name])
        spark = rows.sparkSession
    if paths:
        _point(spark, root, version, form)
    return paths


def _point(spark: SparkSession, root: str, version: str, form: str) -> None:
    seq = (last["seq"] if (last := last_published(spark, root)) else 0) + 1
    spark.createDataFrame([(seq, version, form)], POINTER).coalesce(1).write.mode("append").json(f"{root}/pointer")


def last_published(spark: SparkSession, root: str) -> Row | None:
    """``seq, version, form`` of the version published last, if there is one."""
    try:
        return _last(spark, root.rstrip("/"))
    except AnalysisException:  # nothing is published yet
        return None


def _last(spark: SparkSession, root: str) -> Row:
    return spark.read.schema(POINTER).json(f"{root}/pointer").orderBy(F.desc("seq")).first()


def published(spark: SparkSession, root: str, schema: str | None = None, part: str | None = None) -> DataFrame:
    """The version published last, whatever its name, or one ``part`` of it; ``schema`` keeps columns that JSON leaves out where they are null."""
    root = root.rstrip("/")
    last = _last(spark, root)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.format(last["form"]).load("/".join([root, "versions", last["version"], *([part] if part else [])]))
