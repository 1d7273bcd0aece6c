"""The daily run: landed files to bronze, bronze to postings, postings to days."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplake.operators import lifecycle as lc
from snaplake.sources import landing as contract
from snaplake.streaming import bronze, state


@dataclass(frozen=True)
class Day:
    """What a run leaves: bronze, the audit and the state of postings as tables, the rest as plans over them."""

    bronze: DataFrame
    runs: DataFrame
    postings: DataFrame
    clean: DataFrame
    quarantine: DataFrame
    daily: DataFrame


def run(spark: SparkSession, landing: str, run_landing: str, warehouse: str, posting: T.StructType = contract.POSTING, audit: T.StructType = contract.RUN) -> Day:
    """Stream what has landed since the last run, and bring the state of the postings up to date with that alone.

    A day that lands late extends the lifetime of its postings, and as it was loaded last its attributes count as the latest.
    """
    root = warehouse.rstrip("/")
    rows = bronze.ingest_postings(spark, landing, f"{root}/bronze", f"{root}/bronze-checkpoint", posting)
    runs = bronze.ingest_runs(spark, run_landing, f"{root}/runs", f"{root}/runs-checkpoint", audit)
    order = F.struct("loaded_at", "snapshot_day", "source_file", "job_key")
    every = lc.from_summary(state.follow(spark, f"{root}/bronze", f"{root}/postings", f"{root}/postings-checkpoint", order))
    good = lc.clean(every)
    return Day(rows, runs, every, good, lc.quarantine(every), lc.daily_activity(rows, good))
