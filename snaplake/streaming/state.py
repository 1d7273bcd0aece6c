"""Postings kept up to date from new rows alone: a summary of each posting, merged with that of every batch.

The state is a published table, so a reader sees it before or after a batch and never between.  Its version names the last batch in it; a batch that comes again, after a failure
or by hand, changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession

from snaplake.operators import lifecycle as lc
from snaplake.operators.upsert import last_published, publish, published


def apply_batch(rows: DataFrame, batch: int, root: str, order: Column | None = None) -> bool:
    """Merge the summary of ``rows`` into the state below ``root``, unless this or a later batch is in it; whether it was.

    Reads the batch and the state, whatever came before.
    """
    spark = rows.sparkSession
    last = last_published(spark, root)
    if last is not None and int(last["version"].split("-")[0]) >= batch:
        return False
    new = lc.summary(rows, order)
    # a name of its own, as a try that failed before its pointer may have left files
    publish(new if last is None else lc.merged(published(spark, root), new), root, f"{batch}-{uuid.uuid4().hex}")
    return True


def follow(spark: SparkSession, table: str, root: str, checkpoint: str, order: Column | None = None) -> DataFrame | None:
    """Apply what has been added to ``table`` (Parquet, append-only) since the last call; the state, or None while there is none."""
    schema = spark.read.parquet(table).schema
    stream = spark.readStream.schema(schema).parquet(table).writeStream.foreachBatch(lambda rows, batch: apply_batch(rows, batch, root, order) and None)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return published(spark, root) if last_published(spark, root) is not None else None
