"""Connected components of a graph given as rows of edges, by minimum labels with pointer jumping.

Cases: loops (``a = b``) and edges with a null end are left out, repeated edges count once, and their order doesn't matter; a node without
other edges isn't in the result; no edges give an empty table; columns other than ``a, b`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.storage import Scratch, stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``id, label`` of every node of ``edges`` (``a, b``, longs): the smallest id it can reach.

    The result is a written table.  Each round takes the smallest label among neighbours and then the label of that label, so the rounds grow with the logarithm
    of the longest path.  Rounds are written tables; joins are equi-joins that Spark can split at a hub.
    """
    scratch, rounds = Scratch(edges.sparkSession), Scratch(edges.sparkSession)
    both = edges.select("a", "b").where("a != b")
    both = scratch.stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = rounds.stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), name)
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        step = rounds.stored(step, f"{name}-step")
        jump = step.select(F.col("id").alias("via"), F.col("label").alias("far"))
        labels = rounds.stored(step.join(jump, F.col("label") == F.col("via"), "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")), f"{name}-jump")
        rounds.drop(keep=1)
        if labels.where("label != old").isEmpty():
            out = stored(labels.select("id", "label"), f"{name}-done")
            rounds.drop()
            scratch.drop()
            return out
        labels = labels.select("id", "label")
