"""Landed files: declared schemas, rescued values, lineage, and small configuration tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The landing contract: all strings, so that no value is lost on the way in.
POSTING = T.StructType([T.StructField(c, T.StringType()) for c in "job_key source source_id company title location url raw_text posted_at ingested_at list_ref fetch_mode snapshot_date".split()])
RUN = T.StructType([
    T.StructField("snapshot_date", T.StringType()), T.StructField("run_started_at", T.StringType()), T.StructField("company", T.StringType()), T.StructField("source", T.StringType()), T.StructField("postings", T.IntegerType()),
    T.StructField("fetched_full", T.IntegerType()), T.StructField("reused", T.IntegerType()), T.StructField("seconds", T.DoubleType()), T.StructField("error", T.StringType()),
])


def by_contract(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Parse JSON lines by a declared schema; ``rescued`` keeps the whole line if a value or a key does not fit.

    The corrupt-record column catches broken lines and wrong types; keys outside the contract are found by name.
    """
    fields = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    j = F.from_json(column, fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    extra = F.size(F.array_except(F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")), F.array(*[F.lit(f.name) for f in schema.fields]))) > 0
    rest = [c for c in lines.columns if c != column]
    rows = lines.select(*rest, j.alias("j"), F.when(extra, F.col(column)).alias("unknown"))
    return rows.select(*[F.col(f"j.{f.name}") for f in schema.fields], F.coalesce("j._corrupt", "unknown").alias("rescued"), *rest)


def with_lineage(rows: DataFrame) -> DataFrame:
    """Source file and load time of rows read from files."""
    return rows.select("*", F.col("_metadata.file_path").alias("source_file"), F.current_timestamp().alias("loaded_at"))


def snapshot_day(*texts: str) -> Column:
    """The date that a text says, else the date of the timestamp that the next says."""
    return F.coalesce(F.col(texts[0]).try_cast("date"), *[F.col(t).try_cast("timestamp").cast("date") for t in texts[1:]])


def csv_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV of strings; blanks are empty strings."""
    return spark.read.csv(path, header=True, schema=T.StructType([T.StructField(c, T.StringType()) for c in columns])).fillna("")


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Configuration as a table: boards, vocabulary, profile.  Its size is what somebody has written down."""
    return spark.createDataFrame(list(rows), schema)
