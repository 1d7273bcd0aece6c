"""Queries and, beside each, the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Source:
    """The tables and views of one call."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._day = None

    def __getitem__(self, name: str) -> DataFrame:
        return fixtures.frame(self.spark, self.sf_dir, name)

    def latest_day(self) -> DataFrame:
        return self["events"].agg(F.max(F.col("ts").cast("date")).alias("as_of"))

    def as_of(self) -> F.Column:
        """The last day of the snapshots, which stands for today: one value, read once a call of a query."""
        if self._day is None:
            self._day = self.latest_day().first()["as_of"]
        return F.lit(self._day)


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Source], DataFrame]], Callable[[Source], DataFrame]]:
    """Register ``f(source)`` under ``name``; ``sql`` has braces around tables and views."""

    def add(f: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        if sql:
            SQL[name] = fixtures.duckdb_with(sql)
        return f

    return add


def text_dates(rows: DataFrame) -> DataFrame:
    """Dates and times as text, arrays joined: values that compare the same everywhere."""
    out = {}
    for f in rows.schema.fields:
        kind = f.dataType.typeName()
        if kind == "date":
            out[f.name] = F.col(f.name).cast("string")
        elif kind in ("timestamp", "timestamp_ntz"):
            out[f.name] = F.date_format(f.name, "yyyy-MM-dd HH:mm:ss")
        elif kind == "array":
            out[f.name] = F.array_join(f.name, "|")
    return rows.withColumns(out) if out else rows


def mean_1(c: str) -> str:
    """SQL of a mean to one place, half up, in whole numbers (values of at least 0 with up to six places)."""
    return f"(2 * sum(CAST(round({c} * 1000000) AS HUGEINT)) + 100000 * count({c})) // (200000 * count({c})) / 10"
