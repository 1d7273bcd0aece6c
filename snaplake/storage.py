"""Tables that cut lineage: written once to the folder that all executors share, then read back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    Without that setting a session on one machine uses its warehouse; on a cluster it is an error, as a default folder
    may be one of a single machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below :func:`shared_dir` that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return what was written.

    The result survives the loss of any executor, does not recompute its inputs and never changes when it is
    read twice.  ``zstd`` keeps the files small.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    for paths in _WATCHED:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_WATCHED: list[list[str]] = []


@contextmanager
def only_result_stays(spark: SparkSession) -> Iterator[None]:
    """Delete what :func:`stored` has written in this block once it ends, but for the last table."""
    paths: list[str] = []
    _WATCHED.append(paths)
    try:
        yield
    finally:
        _WATCHED.remove(paths)
    for path in paths[:-1]:
        drop_path(spark, path)


class Scratch:
    """Written tables that go once a later one has been written, so that the shared folder holds what is still needed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        return stored(df, name, self.paths[-1])

    def drop(self, keep: int = 0) -> None:
        """Delete all but the last ``keep`` tables."""
        gone = self.paths[: len(self.paths) - keep]
        self.paths = self.paths[len(gone) :]
        for path in gone:
            drop_path(self.spark, path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table or folder is there, by Hadoop's own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`stored` or the streaming sinks, through Hadoop's own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows that a partition of what is dealt by number has on average.
ROWS = 250_000


def pieces(*tables: DataFrame, rows: int = ROWS) -> int:
    """How many partitions leave each ``rows`` rows of the largest table, and no fewer than Spark would make by itself.

    A number given to ``repartition`` holds, whereas Spark merges partitions up to a size in compressed bytes; so what a task holds does not depend on the size of the tables.
    """
    least = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, *(-(-t.count() // rows) for t in tables))


def dealt_alike(many: DataFrame, key: str, few: DataFrame, other: str, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """The two sides of a join of ``key`` with ``other``: ``few`` is sent to ``many`` if it has no more than ``rows`` rows, else both are dealt by key into :func:`pieces`.

    Left to Spark, a larger table is sorted in its own number of partitions, so what a task sorts grows with the tables.
    Rows of one key of ``many`` stay in one task, which spills what it sorts.
    """
    if few.count() <= rows:
        return many, F.broadcast(few)
    n = pieces(many, few, rows=rows)
    return many.repartition(n, key), few.repartition(n, other).hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; events carry timestamps without a zone and are read as such."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
