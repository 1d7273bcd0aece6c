"""Canonical exact document fingerprints, with DataFrame and SQL functions only.

Canonical form: Unicode normalisation (NFKC), full case folding, normalisation again (folding can undo it), each run of white
space one space, none at the ends.  A fingerprint is two chained 64-bit xxhashes of it.  Documents are grouped by fingerprint, and in
groups of two or more the canonical bytes are compared: where the least and the greatest of a group differ, its members whose bytes
are not the least get their SHA-256 appended, so equal fingerprints mean equal bytes.  Edited texts are named by the same rule.

Cases: null text counts as empty; a null ``doc_id`` comes last in descending order; rows with one ``doc_id`` are ordered by text hash; the
only row of a table is its own next document; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplake.storage import Scratch, stored

#: Rows dealt together to find each row's next; most such ranges.
RANGE_ROWS, MOST_RANGES = 2000, 1 << 16
#: Ids are broadcast up to this many (8 bytes each); beyond, the texts are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def canonical(text: Column) -> Column:
    """The canonical form, by the Unicode library that Spark itself uses for collations."""
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.btrim(F.regexp_replace(compose(folded), r"[\s\p{Z}\x85]+", " "))


def wide_hash(form: Column) -> Column:
    """128 bits in hex: a hash, and a hash that starts from it."""
    first = F.xxhash64(form)
    return F.lower(F.concat(F.lpad(F.hex(first), 16, "0"), F.lpad(F.hex(F.xxhash64(first, form)), 16, "0")))


def _ranges(docs: DataFrame) -> tuple[Column, list[tuple]]:
    """The range of a ``doc_id`` as a column, from equal-depth bounds, and (range, its largest id) in descending order.

    Only ids are read.  The bounds are what a range partitioner holds, a number for ``RANGE_ROWS`` rows.
    """
    n = docs.count()
    fan = max(1, isqrt(max(1, min(MOST_RANGES, ceil(n / RANGE_ROWS)) - 1)) + 1)
    if fan == 1:
        own: Column = F.lit(0)
    else:
        cuts = sorted(set(docs.select(F.percentile_approx("doc_id", [k / fan**2 for k in range(1, fan**2)], 100_000).alias("q")).first()["q"] or []))
        groups = [cuts[i : i + fan] for i in range(0, len(cuts), fan)] or [[]]
        heads = F.array(*[F.lit(g[0]).cast("long") for g in groups[1:]]) if len(groups) > 1 else F.expr("CAST(array() AS array<bigint>)")
        below = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col("doc_id")))
        inner = F.array(*[F.array(*[F.lit(c).cast("long") for c in g]) for g in groups])
        own = below(heads) * (fan + 1) + below(F.element_at(inner, below(heads) + 1))
    own = F.coalesce(own, F.lit(-1)) if fan > 1 else own
    firsts = docs.select("doc_id", own.alias("range")).groupBy("range").agg(F.max("doc_id").alias("top")).orderBy(F.desc("range")).collect()
    return own, [(r["range"], r["top"]) for r in firsts]


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, hash, next_text, next_hash`` where next is in descending ``doc_id``, and after the last comes the first.

    Rows are dealt by ranges of ids, once; the first row of each range is dealt to the range before it as well.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own, firsts = _ranges(docs)
    before = [(top, firsts[i - 1][0]) for i, (_, top) in enumerate(firsts)]  # the first range's row goes to the last
    tops = docs.sparkSession.createDataFrame(before, "top long, range int")
    rows = docs.withColumn("range", own.cast("int")).withColumn("extra", F.lit(False))
    extra = docs.join(F.broadcast(tops), F.col("doc_id").eqNullSafe(F.col("top"))).select("doc_id", "text", "range", F.lit(True).alias("extra"))
    every = rows.unionByName(extra).withColumn("hash", wide_hash(canonical(F.col("text"))))
    order = Window.partitionBy("range").orderBy("extra", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    led = every.withColumns({"next_text": F.lead("text").over(order), "next_hash": F.lead("hash").over(order)})
    return led.where(~F.col("extra")).select("doc_id", "text", "hash", "next_text", "next_hash")


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last half replaced by as much of the beginning of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def _forms(docs: DataFrame, light: DataFrame) -> DataFrame:
    """``doc_id, form, hash`` of the documents whose hash another document shares."""
    groups = light.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    scratch = Scratch(docs.sparkSession)
    members = scratch.stored(light.join(groups.select("hash").hint("merge"), "hash").select(F.col("doc_id").alias("member")).distinct(), "fingerprint-members")
    if members.count() <= BROADCAST_IDS:
        members = F.broadcast(members)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members, F.col("doc_id").eqNullSafe(F.col("member")), "left_semi")
    return own.select("doc_id", canonical(F.col("text")).alias("form")).withColumn("hash", wide_hash(F.col("form")))


def _collisions(forms: DataFrame) -> DataFrame:
    """``hash, head``: the hashes that stand for different canonical bytes, and the digest of the least of these.

    Each bucket's bytes are compared by their least and greatest.  Both are combined before the shuffle, so a bucket that holds a third of
    all documents sends a row a task.
    """
    return forms.groupBy("hash").agg(F.min("form").alias("least"), F.max("form").alias("most")).where("least != most").select("hash", F.sha2("least", 256).alias("head"))


def named(hash_: Column, digest: Column, head: Column) -> Column:
    """A fingerprint: the hash, and the digest of the bytes too where ``head`` says that the hash stands for others as well."""
    return F.when(head.isNull() | (digest == head), hash_).otherwise(F.concat_ws("-", hash_, digest))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited, near_next`` of each row.

    An exact fingerprint is like another or it isn't: likeness is 1 where the canonical bytes are equal, else 0.
    """
    pairs = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    pairs = pairs.withColumn("edited_form", canonical(F.col("edited"))).withColumn("edited_hash", wide_hash(F.col("edited_form")))
    # bytes are compared where hashes are equal
    like = lambda h, other: F.when(F.col("hash") != F.col(h), F.lit(0.0)).otherwise((canonical(F.col("text")) == other).cast("double"))
    light = pairs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "hash", F.sha2("text", 256).alias("text_sha256"), "edited_hash", F.sha2("edited_form", 256).alias("edited_digest"),
        like("edited_hash", F.col("edited_form")).alias("near_edited"), like("next_hash", canonical(F.col("next_text"))).alias("near_next"),
    )
    light = stored(light, "fingerprints")
    collisions = stored(_collisions(_forms(docs, light)), "fingerprint-collisions")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    if collisions.isEmpty():
        return light.withColumns({"fingerprint": F.col("hash"), "edited_fingerprint": F.col("edited_hash")}).select(*names)
    # rare: the digests of the documents in such buckets, by the text they were made of
    inside = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    inside = inside.select(F.sha2("text", 256).alias("t"), canonical(F.col("text")).alias("form")).withColumn("h", wide_hash(F.col("form"))).join(collisions.select(F.col("hash").alias("h")), "h", "left_semi")
    digests = inside.select("t", F.sha2("form", 256).alias("digest")).distinct()
    heads = lambda h, name: collisions.select(F.col("hash").alias(h), F.col("head").alias(name))
    light = light.join(digests, F.col("text_sha256") == F.col("t"), "left").join(heads("oh", "own_head"), F.col("hash") == F.col("oh"), "left").join(heads("eh", "edited_head"), F.col("edited_hash") == F.col("eh"), "left")
    return light.withColumns({"fingerprint": named(F.col("hash"), F.col("digest"), F.col("own_head")), "edited_fingerprint": named(F.col("edited_hash"), F.col("edited_digest"), F.col("edited_head"))}).select(*names)
