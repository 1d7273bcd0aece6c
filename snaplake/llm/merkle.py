"""Merkle manifest of a dataset: a digest of every row, trees over them, and for each row the proof that it is in.

Rows are leaves.  The leaves of a tree are ranked by a number without a window over the tree: a range shuffle, sorted partitions, and the counts of
each partition.  Every node carries the interval ``[lo, hi)`` of leaf ranks that it covers.  Levels are built eight at a time: 256 neighbouring nodes
meet in one row, whose higher-order functions hash them level by level, so a tree of any size takes a shuffle for every eight levels, the later ones of a 256th of the
rows, and no row gets longer than 511 nodes.

Ancestors are attached by a containment join inside such a bucket of levels: a node's ancestors are those whose interval holds its own, and what is
left of a parent's interval outside the child's is the sibling.  Paths of buckets are put together from the top: the path of a bucket's first
node goes on with the path of the bucket above, which 256 nodes share.

Cases: a null value has a digest of its own (``-``); a null tree key is a tree of its own, before the others; null order values come first, and equal ones are
ordered by digest, so equal rows are leaves of their own in a fixed order; a lone leaf is its own subroot, with an empty path; empty tables give empty
manifests; columns that are not asked for don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplake.storage import Scratch

#: Levels that are built and joined together; 2 ** LEVELS nodes meet in one row.
LEVELS = 8
STEP = "struct<level: int, left: string, right: string>"


def digest(*columns: Column) -> Column:
    """SHA-256 of the values' texts, each with its length in bytes before it and null as ``-``."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def ranked(rows: DataFrame, tree: str, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``rank``, from 0 in each ``tree``, and ``leaves``, the size of the tree; a tree's rows may lie in any number of partitions."""
    placed = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    placed = scratch.stored(placed, "merkle-sorted")
    parts = placed.groupBy(tree, "__part").agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    before = Window.partitionBy(tree).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"__before": F.coalesce(F.sum("__rows").over(before), F.lit(0)), "leaves": F.sum("__rows").over(Window.partitionBy(tree))})
    return placed.join(parts, [tree, "__part"]).withColumn("rank", F.col("__at") - F.col("__first") + F.col("__before")).drop("__part", "__at", "__rows", "__first", "__before")


def _upwards(nodes: Column) -> Column:
    """The parents of an array of nodes in order: each two neighbours, the last one perhaps alone."""
    first = lambda i: F.get(nodes, (2 * i).cast("int"))
    second = lambda i: F.get(nodes, (2 * i + 1).cast("int"))
    kid = lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["hash"].alias("hash"))

    def parent(i: Column) -> Column:
        a, b = first(i), second(i)
        kids = F.when(b.isNull(), F.array(kid(a))).otherwise(F.array(kid(a), kid(b)))
        return F.struct(a["lo"].alias("lo"), F.coalesce(b["hi"], a["hi"]).alias("hi"), F.sha2(F.concat(a["hash"], F.coalesce(b["hash"], F.lit(""))), 256).alias("hash"), kids.alias("kids"))

    return F.transform(F.sequence(F.lit(0), ((F.size(nodes) - 1) / 2).cast("int")), parent)


def _height(leaves: str) -> Column:
    """Levels above the leaves: the digits of the last rank in base 2."""
    return F.when(F.col(leaves) > 1, F.length(F.bin(F.col(leaves) - 1))).otherwise(0)


@dataclass
class Manifest:
    """Written tables: ``leaves`` (tree, rank, hash and what else the rows hold), ``bands`` (nodes of each run of levels), ``roots`` (tree, leaves, subroot)."""

    leaves: DataFrame
    bands: list[DataFrame]
    roots: DataFrame

    def nodes(self) -> DataFrame | None:
        """``tree, level, lo, hi, hash, kids`` of all nodes above the leaves; none where no tree has two leaves."""
        if not self.bands:
            return None
        out = self.bands[0]
        for band in self.bands[1:]:
            out = out.unionByName(band)
        return out.select("tree", "level", "lo", "hi", "hash", "kids")


def build(rows: DataFrame, order: list[str], scratch: Scratch | None = None) -> Manifest:
    """Trees over ``rows``, which have ``tree`` (string, not null), ``hash`` and the columns of ``order``."""
    scratch = scratch or Scratch(rows.sparkSession)
    leaves = scratch.stored(ranked(rows, "tree", [*order, "hash"], scratch).withColumn("height", _height("leaves")), "merkle-leaves")
    below = leaves.select("tree", "height", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "hash")
    none = F.array().cast("array<struct<lo: bigint, hi: bigint, hash: string>>")
    roots = leaves.where("leaves = 1").select("tree", "leaves", F.col("hash").alias("subroot"))
    bands: list[DataFrame] = []
    base = 0
    while not below.where(F.col("height") > base).isEmpty():
        bucket = F.shiftright("lo", base + LEVELS).alias("bucket")
        group = below.where(F.col("height") > base).groupBy("tree", "height", bucket).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "hash"))).alias("at"))
        bottom = F.transform("at", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["hash"].alias("hash"), none.alias("kids")))
        steps = F.sequence(F.lit(1), F.least(F.lit(LEVELS), F.col("height") - base))
        levels = F.aggregate(steps, F.array(bottom), lambda all_, _: F.concat(all_, F.array(_upwards(F.element_at(all_, -1)))))
        level = group.select("tree", "height", "bucket", F.posexplode(levels).alias("level", "at")).where("level > 0")
        nodes = level.select("tree", "height", "bucket", (F.col("level") + base).alias("level"), F.explode("at").alias("node")).select("tree", "height", "bucket", "level", "node.*")
        nodes = scratch.stored(nodes, f"merkle-nodes-{base}")
        bands.append(nodes)
        base += LEVELS
        sizes = F.col("hi").alias("leaves")  # of a root, which starts at 0
        roots = roots.unionByName(nodes.where("level = height").select("tree", sizes, F.col("hash").alias("subroot")))
        below = nodes.where(F.col("level") == base).select("tree", "height", "lo", "hi", "hash")
    return Manifest(leaves, bands, scratch.stored(roots, "merkle-roots"))


def paths(manifest: Manifest, scratch: Scratch) -> DataFrame:
    """``manifest.leaves`` with ``path``: from the leaf upwards, what stands left and right of it at each level (empty texts for a node without sibling)."""
    empty = F.array().cast(f"array<{STEP}>")
    above = None
    for k in reversed(range(len(manifest.bands))):
        base, nodes = k * LEVELS, manifest.bands[k]
        bottoms = manifest.leaves.where("height > 0").select("tree", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi")) if k == 0 else manifest.bands[k - 1].where(F.col("level") == base).where(F.col("height") > base).select("tree", "lo", "hi")
        a, b = bottoms.withColumn("bucket", F.shiftright("lo", base + LEVELS)).alias("a"), nodes.select("tree", "bucket", "level", "lo", "hi", "kids").alias("b")
        inside = (F.col("b.lo") <= F.col("a.lo")) & (F.col("a.hi") <= F.col("b.hi"))
        rest = lambda side: F.coalesce(F.get(F.filter("b.kids", side), 0)["hash"], F.lit(""))
        left, right = rest(lambda x: x["hi"] <= F.col("a.lo")), rest(lambda x: x["lo"] >= F.col("a.hi"))
        joined = a.join(b, (F.col("a.tree") == F.col("b.tree")) & (F.col("a.bucket") == F.col("b.bucket")) & inside)
        steps = joined.select("a.tree", "a.bucket", "a.lo", F.struct(F.col("b.level").cast("int").alias("level"), left.alias("left"), right.alias("right")).alias("step"))
        own = steps.groupBy("tree", "bucket", "lo").agg(F.sort_array(F.collect_list("step")).alias("path"))
        if above is not None:
            upper = above.select("tree", F.shiftright("lo", base + LEVELS).alias("bucket"), F.col("path").alias("rest"))
            own = own.join(upper, ["tree", "bucket"], "left").withColumn("path", F.concat("path", F.coalesce("rest", empty))).drop("rest")
        above = own.select("tree", "lo", "path")
        if k:
            above = scratch.stored(above, f"merkle-paths-{base}")
    if above is None:
        return manifest.leaves.withColumn("path", empty)
    return manifest.leaves.join(above.withColumnRenamed("lo", "rank"), ["tree", "rank"], "left").withColumn("path", F.coalesce("path", empty))


def folded(leaf: Column, path: str) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def siblings(path: str) -> Column:
    """The siblings along a path, in one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def proofs(rows: DataFrame, tree: Column, order: list[str], scratch: Scratch | None = None) -> DataFrame:
    """``rows`` (with ``hash`` and the columns of ``order``) with ``subroot``, ``root`` and ``path``: trees by ``tree`` (a text), whose subroots are the leaves of one more."""
    scratch = scratch or Scratch(rows.sparkSession)
    keyed = scratch.stored(rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), tree), F.lit(""))), "merkle-digests")
    parts = build(keyed, order, scratch)
    whole = build(parts.roots.select(F.lit("").alias("tree"), F.col("tree").alias("part"), F.col("subroot").alias("hash")), ["part"], scratch)
    tops = paths(whole, scratch).select(F.col("part").alias("tree"), F.col("hash").alias("subroot"), F.col("path").alias("top"))
    roots = whole.roots.select(F.col("subroot").alias("root"))
    tops = scratch.stored(tops.crossJoin(F.broadcast(roots)), "merkle-tops")  # one root
    out = paths(parts, scratch).join(tops, "tree").withColumn("path", F.concat("path", "top"))
    return out.select(*rows.columns, "subroot", "root", "path")


def verified(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Every row of ``docs`` with its leaf, roots and proof, and what becomes of the root where a row has been tampered with.

    Trees are by ``lang``, leaves by ``doc_id``.  Where 7 divides crc32 of the decimal id, one is added to ``n_chars`` after the manifest was made.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    fields = lambda n: digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    rows = docs.select("doc_id", "lang", fields(F.col("n_chars")).alias("hash"), F.when(hit, fields(F.col("n_chars") + 1)).alias("changed"))
    out = proofs(rows, F.col("lang"), ["doc_id"], scratch)
    fold = out.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings("path"), 256).alias("proof_sha256"), folded(F.coalesce("changed", "hash"), "path").alias("folded_root"))
    return fold.withColumn("verified", F.col("folded_root") == F.col("root"))
