"""MinHash near-dedup by a chosen-path set similarity join over word shingles.

1. Each text becomes the set of its distinct shingles; equal sets are one class, which later steps handle once.
2. A class has ``COORDINATES`` minwise tokens (one-permutation hashing, empty bins filled from others).  In each of ``TREES`` trees a
   node picks one coordinate by its own hash and branches its documents by their token there.  A class finds its path alone; nodes are
   counted level by level, and a node of at most ``SMALL`` classes is a leaf.
3. Small leaves test all their pairs by sketches.  Sets of fewer than ``BITS_BELOW`` shingles have a vector of parities, 1 bit for
   each of 1024 buckets of shingles: each bit in which two vectors differ stands for a shingle that only one set has, so the test
   never refuses a similar pair.  Larger sets are tested by their tokens.  A node that is still large at ``LEVELS`` holds classes
   that agree again and again, which are all taken as candidates of its first one.  Candidates form clusters (connected components).
4. Clusters are compared exhaustively on full sets, by matrix products in cells of bounded rows and bytes.  In a cluster of several
   blocks each block is first compared with itself and the first block, then every candidate pair between parts that are still
   apart is confirmed on its two sets.  What is not linked to the cluster's largest part by then meets every class of the cluster
   by sketches, in cells of thousands of them, and only classes that pass the test with another part go on to full sets, in the cells
   where they passed.  Links join classes to components.

A pair at the threshold misses a tree's first level with probability 0.15, so of pairs in small leaves ``TREES`` = 16
trees lose one in 10**13.  All ``LEVELS`` = 6 are needed only among classes that agree so often that a leaf stays large; there a pair
is lost with probability (1 - 0.85**6)**16 = 0.0005, unless another class connects the two, as is usual in such groups.

Cases: null, empty and blank texts have an empty set and are linked with nothing; a text of fewer words than a shingle is one
shingle; rows that repeat a ``doc_id`` are documents of their own with that id; a null ``doc_id`` takes part, and its component
may be null; empty tables give empty results; other columns are ignored or passed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm import batches as B
from snaplake.llm.components import components
from snaplake.storage import Scratch, stored

WORDS, PERCENT = 5, 85
COORDINATES, TREES, LEVELS, SMALL = 128, 16, 6, 24
#: A node is named by its first level's key (64 bits) and so many bits for each further level; if they collide, a node only holds more.
STEP_BITS = 12
#: Sets of fewer shingles have parities, of at least as many have tokens; similar sets have one of them in common.
BITS_BELOW, TOKENS_FROM, BITS = 2410, 2048, 1024
#: Share of equal tokens below which a pair of larger sets is no candidate: 4.5 deviations under the threshold.
LEAST_EQUAL = 0.71
#: Classes and bytes of sets in one cell, at about twice of which a cluster is compared in blocks; columns of a matrix product.
BLOCK, CELL_BYTES, COLUMNS = 256, 32 << 20, 1 << 14
#: Blocks on a side of one cell of sketches, which so holds some 4096 classes a side, and classes of a side tested at a time.
SIDE, AT_ONCE = 32, 64
#: Buckets of a second vector of parities, by other bits of the shingles, for what passes the first in such a cell.
WIDE = 2048
#: Ids are broadcast up to this many (8 bytes each); beyond, the texts are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_FACTORS = B.mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_PROBES = np.argsort(np.random.default_rng(5).random((COORDINATES, COORDINATES)), axis=1)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi, data, offsets in B.pieces(texts):
        data = B.lower_ascii(data)
        starts, ends, rows = B.word_spans(data, offsets)
        words = B.span_hashes(data, starts, ends)
        bounds = B.row_bounds(rows, hi - lo)
        long = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            long += words[k : k + len(long)] * _FACTORS[k]
        long = B.mix(long)
        for i in range(hi - lo):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= WORDS:
                yield np.unique(long[a : b - WORDS + 1])
            elif b > a:
                yield B.mix(np.array([(words[a:b] * _FACTORS[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def tokens(values: np.ndarray) -> np.ndarray:
    """Minwise tokens of a nonempty sorted set: the least value of each bin; an empty bin copies the next of its own order of bins."""
    width = np.uint64(64 - COORDINATES.bit_length() + 1)
    first = np.searchsorted(values, np.arange(COORDINATES, dtype=np.uint64) << width)
    have = np.diff(np.append(first, len(values))) > 0
    if not have.all():
        first = first[_PROBES[np.arange(COORDINATES), have[_PROBES].argmax(axis=1)]] * ~have + first * have
    return values[first]


def paths(signatures: np.ndarray) -> np.ndarray:
    """Two words for each signature and tree: the key of the first level, and the steps after it from high bits to low."""
    node = np.broadcast_to(B.mix(np.arange(1, TREES + 1, dtype=np.uint64)), (len(signatures), TREES))
    out = np.zeros((len(signatures), TREES, 2), np.uint64)
    rows = np.arange(len(signatures))[:, None]
    for level in range(LEVELS):
        if level:
            coordinate = (B.mix(node + np.uint64(level)) >> np.uint64(40)) % np.uint64(COORDINATES)
        else:  # different trees start with different coordinates
            coordinate = np.broadcast_to((np.arange(TREES) * 9) % COORDINATES, node.shape)
        node = B.mix(node * np.uint64(31) + signatures[rows, coordinate.astype(np.int64)])
        if level:
            out[:, :, 1] |= (node >> np.uint64(64 - STEP_BITS)) << np.uint64(64 - STEP_BITS * level)
        else:
            out[:, :, 0] = node
    return out


SKETCH = "doc_id long, text_key long, n_shingles long, digest binary, parities binary, thumb binary, keys array<long>"


def parities(values: np.ndarray, bits: int = BITS, skip: int = 0) -> bytes:
    """For each bucket of shingles, whether it holds an odd number of them; ``skip`` low bits of a shingle have no part in it."""
    odd = np.bincount(((values >> np.uint64(skip)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, bits, signatures, at = [], [], [], [], []
        for i, values in enumerate(shingle_sets(batch["text"])):
            sizes.append(len(values))
            digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
            bits.append(parities(values) if 0 < len(values) < BITS_BELOW else None)
            if len(values):
                at.append(i)
                signatures.append(tokens(values))
        signatures = np.array(signatures, np.uint64).reshape(-1, COORDINATES)
        low = (B.mix(signatures) & np.uint64(255)).astype(np.uint8)
        keys = paths(signatures).reshape(len(at), 2 * TREES).view(np.int64)
        thumbs: list = [None] * len(sizes)
        for i, k in enumerate(at):
            thumbs[k] = low[i].tobytes() if sizes[k] >= TOKENS_FROM else None
        bounds = np.zeros(len(sizes) + 1, np.int32)
        bounds[np.array(at, np.int64) + 1] = keys.shape[1] if len(at) else 0
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(bounds, dtype=np.int32)), pa.array(keys.ravel()))
        yield pa.record_batch([batch["doc_id"], batch["text_key"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, pa.binary()), pa.array(thumbs, pa.binary()), lists], names=["doc_id", "text_key", "n_shingles", "digest", "parities", "thumb", "keys"])


def _close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a small leaf that may be similar; rows come sorted by leaf, and a leaf may continue in the next batch."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, table]) if rest is not None else table
        if rest.num_rows < SMALL:
            continue
        node = rest["node"].to_numpy()
        cut = int(np.searchsorted(node == node[-1], True)) if node[0] != node[-1] else 0
        yield from _compare(rest.slice(0, cut))
        rest = rest.slice(cut)
    if rest is not None:
        yield from _compare(rest)


def _compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    for lo in range(0, rows.num_rows, 20_000):
        part = rows.slice(lo, 20_000 + SMALL)
        node, cid, size = (part[c].to_numpy() for c in ("node", "cid", "n_shingles"))
        none = bytes(COORDINATES)
        thumb, odd = (np.frombuffer(b"".join(v or none for v in part[c].to_pylist()), t).reshape(len(node), -1) for c, t in (("thumb", np.uint8), ("parities", np.uint64)))
        label, ends = np.arange(len(node)), np.zeros((2, 0), np.int64)
        for k in range(1, SMALL):
            i = np.flatnonzero(node[:-k] == node[k:])
            i = i[i < 20_000]
            j = i + k
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            ok = 100 * small >= PERCENT * large
            ok &= label[i] != label[j]  # what is connected already needs no more pairs: candidates only have to connect
            i, j, both, large = i[ok], j[ok], (small + large)[ok], large[ok]
            ok = _passes(both, large, np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64), (thumb[i] == thumb[j]).sum(axis=1))
            i, j = i[ok], j[ok]
            if len(i):
                ends = np.concatenate([ends, [i, j]], axis=1)
                label = _connected(label, *ends)
                yield pa.record_batch([pa.array(np.minimum(cid[i], cid[j])), pa.array(np.maximum(cid[i], cid[j]))], names=["a", "b"])


def _passes(both: np.ndarray, large: np.ndarray, differ: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Whether pairs may be similar, by the sum and the greater of their sizes, the parities that differ and the tokens that are equal."""
    # similar sets differ in at most (100 - PERCENT) / (100 + PERCENT) of their shingles
    return np.where(large < BITS_BELOW, (100 + PERCENT) * differ <= (100 - PERCENT) * both, equal >= LEAST_EQUAL * COORDINATES)


def _meeting(group: pd.DataFrame) -> pd.DataFrame:
    """Of a cell of sketches, the classes that pass the test with one of another part: ``cid`` with the strip ``i`` and block ``j`` of the pair."""
    loose, every = group[group["loose"]], group[~group["loose"]]
    none_odd, none_thumb = bytes(BITS // 8), bytes(COORDINATES)
    odd = lambda g: np.unpackbits(np.frombuffer(b"".join(v or none_odd for v in g["parities"]), np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.float32)
    thumbs = lambda g: np.frombuffer(b"".join(v or none_thumb for v in g["thumb"]), np.uint8).reshape(-1, COORDINATES)
    odd_b, thumb_b, ones = odd(every), thumbs(every), odd(every).sum(axis=1)
    part_b, size_b, fine_b, cid_b = (every[c].to_numpy() for c in ("part", "n_shingles", "fine", "cid"))
    wide = lambda g: np.frombuffer(b"".join(g["wide"]), np.uint64).reshape(-1, WIDE // 64)
    wide_b = wide(every)
    out = [np.zeros((0, 3), np.int64)]
    for lo in range(0, len(loose), AT_ONCE):
        a = loose.iloc[lo : lo + AT_ONCE]
        part, size, fine, cid = (a[c].to_numpy() for c in ("part", "n_shingles", "fine", "cid"))
        bits = odd(a)
        ok = (part[:, None] != part_b) & (100 * np.minimum(size[:, None], size_b) >= PERCENT * np.maximum(size[:, None], size_b))
        differ = (bits.sum(axis=1)[:, None] + ones - 2 * (bits @ odd_b.T)).astype(np.int64)
        large = np.maximum(size[:, None], size_b)
        equal = (thumbs(a)[:, None, :] == thumb_b).sum(axis=2) if (large[ok] >= BITS_BELOW).any() else np.zeros(ok.shape, np.int64)
        x, y = np.nonzero(ok & _passes(size[:, None] + size_b, large, differ, equal))
        differ = np.bitwise_count(wide(a)[x] ^ wide_b[y]).sum(axis=1, dtype=np.int64)
        passed = (100 + PERCENT) * differ <= (100 - PERCENT) * (size[x] + size_b[y])
        x, y = x[passed], y[passed]
        both = np.concatenate([np.stack([fine[x], fine_b[y], c], axis=1) for c in (cid[x], cid_b[y])])
        out.append(np.unique(both, axis=0))
    found = np.unique(np.concatenate(out), axis=0)
    return pd.DataFrame({"i": found[:, 0], "j": found[:, 1], "cid": found[:, 2]})


def _connected(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of rows after joining rows ``i`` and ``j``: the least of each part."""
    while (label[i] != label[j]).any():
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        label = label[label]
    return label


def leaves(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows ``node, cid`` of small leaves with two or more classes, and of nodes that stay large."""
    tree = lambda t: F.struct(F.col("keys")[2 * t].alias("key"), F.col("keys")[2 * t + 1].alias("steps"))
    rows = classes.select("cid", F.explode(F.array(*map(tree, range(TREES)))).alias("k")).select("cid", "k.*")
    small = None
    for level in range(LEVELS):
        # a node of this level: the first key and the steps down to here
        named = rows.withColumn("node", F.xxhash64("key", F.shiftrightunsigned("steps", 64 - STEP_BITS * level)) if level else F.col("key"))
        counts = named.groupBy("node").agg(F.count("*").alias("members")).where("members > 1")
        met = scratch.stored(named.join(counts.hint("merge"), "node"), f"neardup-level-{level}")  # a sort merge join, which Spark splits at a hot node
        done = met.where(F.col("members") <= SMALL).select("node", "cid")
        small = done if small is None else small.unionByName(done)
        rows = met.where(F.col("members") > SMALL).select("node", "cid", "key", "steps")
    return small, rows.select("node", "cid").distinct()


def candidates(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidate pairs ``a, b``: they connect all that may be similar, and are not all such pairs."""
    small, large = leaves(classes, scratch)
    sketched = small.join(classes.select("cid", "n_shingles", "parities", "thumb"), "cid")
    dealt = sketched.repartition("node").sortWithinPartitions("node", "cid").select("node", "cid", "n_shingles", "parities", "thumb")
    pairs = dealt.mapInArrow(_close_pairs, "a long, b long")
    heads = large.groupBy("node").agg(F.min("cid").alias("a"))
    stars = large.join(heads.hint("merge"), "node").select("a", F.col("cid").alias("b")).where("a != b")
    return pairs.unionByName(stars).distinct()


def links_of(sets: list[np.ndarray]) -> np.ndarray:
    """Exact links as a matrix: 100 * intersection >= PERCENT * union for each pair of sets."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    use = shared[inverse]
    owner, column = owner[use], column[inverse[use]]
    both = np.zeros((n, n), np.float64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = int(shared.sum())
    for lo in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        block = np.zeros((n, min(COLUMNS, total - lo)), np.float32)
        block[owner[a:b], column[a:b] - lo] = 1
        both += block @ block.T
    both = both.astype(np.int64)
    return 100 * both >= PERCENT * (sizes[:, None] + sizes[None, :] - both)


def _spanning(linked: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all that ``linked`` connects, given that equal ``part`` are connected already."""
    root = {}
    for k, p in enumerate(part.tolist()):
        root.setdefault(p, k)
    parent = np.array([root[p] for p in part.tolist()])

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(i), int(j)))
    return out


def _cell(group: pd.DataFrame) -> pd.DataFrame:
    """Spanning links among the rows of one cell that share a cluster and not yet a part."""
    group = group.drop_duplicates("cid").sort_values("cid")
    cid, cluster, part = (group[c].to_numpy() for c in ("cid", "cluster", "part"))
    linked = links_of([np.frombuffer(v, np.uint64) for v in group["values"]]) & (cluster[:, None] == cluster[None, :])
    pairs = _spanning(linked, part)
    return pd.DataFrame({"a": [cid[i] for i, _ in pairs], "b": [cid[j] for _, j in pairs]}, dtype="int64")


def _in_cells(rows: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """Links of rows ``cell, cid, cluster, part, values``, compared within each cell."""
    return scratch.stored(rows.groupBy("cell").applyInPandas(_cell, "a long, b long"), name)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs ``a, b`` whose full sets ``x, y`` are similar."""
    for batch in batches:
        keep = []
        for x, y in zip(batch["x"], batch["y"], strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.record_batch([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _between_parts(pairs: DataFrame, large: DataFrame, scratch: Scratch) -> DataFrame:
    """Links among the candidate ``pairs`` whose classes are in ``large`` and in different parts, confirmed on their sets."""
    part = large.select("cid", "part")
    apart = pairs.join(part.select(F.col("cid").alias("a"), F.col("part").alias("p")), "a").join(part.select(F.col("cid").alias("b"), F.col("part").alias("q")), "b").where("p != q").select("a", "b")
    sets = large.select("cid", "values")
    full = scratch.stored(apart, "neardup-apart").join(sets.select(F.col("cid").alias("a"), F.col("values").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("values").alias("y")), "b")
    return scratch.stored(full.select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long"), "neardup-confirmed")


def _set_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, values = [], []
        for v in shingle_sets(batch["text"]):
            digests.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest())
            values.append(v.tobytes())
        yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(values, pa.binary())], names=["digest", "values"])


def _sets(docs: DataFrame, classes: DataFrame, clusters: DataFrame, scratch: Scratch) -> DataFrame:
    """``cid, cluster, values``: the full sets of all classes in clusters, from the texts of their first documents."""
    wanted = scratch.stored(classes.join(clusters, F.col("cid") == F.col("id")).select("cid", "digest", F.col("first").alias("wanted"), F.col("label").alias("cluster")), "neardup-wanted")
    ids = wanted.select("wanted").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    values = texts.select("text").mapInArrow(_set_values, "digest binary, values binary")
    return scratch.stored(values.join(wanted, "digest").select("cid", "cluster", "values").dropDuplicates(["cid"]), "neardup-sets")


def links(docs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links ``a, b`` between classes that connect every component of similar sets."""
    levels = Scratch(docs.sparkSession)
    pairs = scratch.stored(candidates(classes, levels), "neardup-pairs")
    levels.drop()
    clusters = components(pairs, "neardup-clusters")
    sets = _sets(docs, classes, clusters, scratch)
    sizes = sets.groupBy("cluster").agg(F.count("*").alias("members"), F.sum(F.length("values")).alias("bytes"))
    one_cell = (F.col("members") <= BLOCK) & (F.col("bytes") <= 2 * CELL_BYTES)
    total = sizes.where(one_cell).agg(F.sum("members").alias("n"), F.sum("bytes").alias("bytes")).first()
    bins = max(1, (total["n"] or 0) // (BLOCK // 2), (total["bytes"] or 0) // CELL_BYTES)
    sized = sets.join(sizes, "cluster")
    # one block: many clusters share a cell, and only pairs within a cluster count
    small = sized.where(one_cell).select(F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(bins))).alias("cell"), "cid", "cluster", F.col("cid").alias("part"), "values")
    found = _in_cells(small, "neardup-links", scratch)
    large = sized.where(~one_cell).withColumn("blocks", F.ceil(F.greatest(F.col("members") / (BLOCK // 2), F.col("bytes") / (CELL_BYTES // 2))).cast("long"))
    if large.isEmpty():
        return found
    large = scratch.stored(large.withColumn("block", F.pmod(F.xxhash64("cid"), "blocks")), "neardup-large")
    cell = lambda a, b: F.concat_ws("-", F.lit("l"), "cluster", a, b)
    first = large.withColumn("with", F.explode(F.when(F.col("block") == 0, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))))
    star = _in_cells(first.select(cell(F.lit(0), "with").alias("cell"), "cid", "cluster", F.col("cid").alias("part"), "values"), "neardup-star", scratch)
    with_parts = lambda edges: large.join(components(edges, "neardup-parts").withColumnRenamed("id", "cid"), "cid", "left").withColumn("part", F.coalesce("label", "cid")).drop("label")
    star = star.unionByName(_between_parts(pairs, with_parts(star), scratch))
    large = with_parts(star)
    counted = scratch.stored(large.groupBy("cluster", "part").agg(F.count("*").alias("k")), "neardup-counts")
    main = counted.groupBy("cluster").agg(F.max(F.struct("k", "part")).alias("top"), F.sum("k").alias("all")).select(F.col("cluster").alias("of"), F.col("top.part").alias("main"), (F.col("all") - F.col("top.k")).alias("others"))
    open_ = large.join(main.where("others > 0"), F.col("cluster") == F.col("of")).withColumn("strips", F.ceil(F.col("others") / (BLOCK // 2)).cast("long"))
    open_ = scratch.stored(open_.withColumn("strip", F.when(F.col("part") != F.col("main"), F.pmod(F.xxhash64("cid", F.lit(1)), "strips"))), "neardup-open")
    met = _met(open_, classes, scratch)
    full = met.join(open_.select("cid", "cluster", "part", "values"), "cid")
    rest = _in_cells(full.select(cell("i", "j").alias("cell"), "cid", "cluster", "part", "values"), "neardup-rest", scratch)
    return found.unionByName(star).unionByName(rest)


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [parities(np.frombuffer(v.as_buffer(), np.uint64), WIDE, 20) for v in batch["values"]]
        yield pa.record_batch([batch["cid"], pa.array(bits, pa.binary())], names=["cid", "wide"])


def _met(rows: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """``i, j, cid``: the classes of ``rows`` that may be linked with another part, by the strip and block where they meet.

    Rows with a ``strip`` are loose.  Each meets every class of its cluster in one cell of ``SIDE`` strips and blocks.
    """
    wide = rows.select("cid", "values").mapInArrow(_wide, "cid long, wide binary")
    sketched = scratch.stored(rows.drop("values").join(classes.select("cid", "n_shingles", "parities", "thumb"), "cid").join(wide, "cid"), "neardup-grid")
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / SIDE).cast("long") - 1)
    side = lambda c: F.floor(F.col(c) / SIDE).cast("long")
    what = ["cid", "part", "n_shingles", "parities", "thumb", "wide"]
    every = sketched.select("cluster", F.explode(up_to("strips")).alias("si"), side("block").alias("sj"), F.lit(False).alias("loose"), F.col("block").alias("fine"), *what)
    loose = sketched.where(F.col("strip").isNotNull()).select("cluster", side("strip").alias("si"), F.explode(up_to("blocks")).alias("sj"), F.lit(True).alias("loose"), F.col("strip").alias("fine"), *what)
    return scratch.stored(every.unionByName(loose).groupBy("cluster", "si", "sj").applyInPandas(_meeting, "i long, j long, cid long"), "neardup-met")


def _labelled(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_shingles, label, component_id`` of each row, written; ``label`` numbers components, null for empty sets."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(_sketch, SKETCH)
    scratch = Scratch(docs.sparkSession)
    sketches = scratch.stored(rows.withColumn("row_id", F.monotonically_increasing_id()), "neardup-sketches")
    heads = sketches.where("n_shingles > 0").groupBy("digest").agg(F.min("row_id").alias("cid"), F.min("doc_id").alias("least"))
    joined = sketches.join(heads.select("cid", "least"), F.col("row_id") == F.col("cid")).select("cid", "least", F.col("doc_id").alias("first"), "digest", "n_shingles", "parities", "thumb", "keys")
    classes = scratch.stored(joined, "neardup-classes")
    labels = components(links(docs, classes, scratch), "neardup-components")
    labelled = classes.select("cid", "digest", "least").join(labels, F.col("cid") == F.col("id"), "left").select("digest", "least", F.coalesce("label", "cid").alias("label"))
    named = labelled.join(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("digest", "label", "component_id")
    out = sketches.select("doc_id", "text_key", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    done = stored(out.select("doc_id", "text_key", "n_shingles", "label", component.alias("component_id")), "neardup-result")
    scratch.drop()
    return done


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs``."""
    return _labelled(docs).select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, all columns kept: its smallest ``doc_id``, and of its rows the first by text hash.

    Rows are named by id and text hash, and what goes is joined away.  Only if equal rows are in the table are they dealt by that name.
    """
    found = _labelled(docs)
    name = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    best = found.where("label IS NOT NULL").groupBy("label").agg(F.min(name).alias("best")).select(F.col("label").alias("of"), "best")
    others = found.join(best, F.col("label") == F.col("of")).where(name != F.col("best"))
    own_id, own_key = B.unused(docs.columns, "__id"), B.unused(docs.columns, "__key")
    named = lambda rows: rows.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_key))
    out = docs.join(named(others).distinct(), same, "left_anti")
    equal = named(found.where("n_shingles > 0")).groupBy(own_id, own_key).count().where("count > 1").drop("count")
    if equal.isEmpty():
        return out
    return out.join(equal, same, "left_anti").unionByName(out.join(equal, same, "left_semi").dropDuplicates(["doc_id", "text"]))
