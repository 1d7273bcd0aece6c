"""Exactly-once ingestion of landed files into append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplake.sources.landing import by_contract, snapshot_day, with_lineage


#: Files of a landed day.
FILES = 4


def stream_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """New JSON-lines files below ``path``, parsed by a declared schema, with rescued lines and lineage.

    Files are read as text so that keys outside the contract can be seen.
    """
    lines = with_lineage(spark.readStream.option("recursiveFileLookup", True).text(path))
    return by_contract(lines, schema)


def ingest(rows: DataFrame, table: str, checkpoint: str, partition_by: str | None = None) -> None:
    """Append what is new and stop.  The checkpoint remembers files, so a second run adds nothing and a backlog waits safely."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.start(table).awaitTermination()


def ingest_postings(spark: SparkSession, landing: str, table: str, checkpoint: str, schema: T.StructType) -> DataFrame:
    """Postings with their day; returns the table."""
    rows = stream_json(spark, landing, schema).withColumn("snapshot_day", snapshot_day("snapshot_date", "ingested_at"))
    ingest(rows, table, checkpoint)
    return spark.read.parquet(table)


def ingest_runs(spark: SparkSession, landing: str, table: str, checkpoint: str, schema: T.StructType) -> DataFrame:
    """The audit of fetch runs, from a folder of its own."""
    rows = stream_json(spark, landing, schema).withColumn("snapshot_day", snapshot_day("snapshot_date", "run_started_at"))
    ingest(rows, table, checkpoint)
    return spark.read.parquet(table)


def full_refresh(spark: SparkSession, landing: str, table: str, checkpoint: str, schema: T.StructType, version: str) -> DataFrame:
    """All landed files again, into a new version with a checkpoint of its own; load times change."""
    return ingest_postings(spark, landing, f"{table}-{version}", f"{checkpoint}-{version}", schema)


def land(rows: DataFrame, path: str, day: str = "snapshot_date") -> None:
    """Write rows as JSON lines, a folder a day; null fields are left out, as sources do.

    A day is dealt over ``FILES`` tasks, each of which writes it a file.
    """
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(FILES))
    rows.withColumn("__day", F.col(day)).repartition("__day", spread).write.partitionBy("__day").mode("append").json(path)
