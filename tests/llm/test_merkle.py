import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from snaplake.llm import merkle as M
from snaplake.storage import Scratch


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    n = row["n_chars"] if row["n_chars"] is None else row["n_chars"] + more
    fields = [row["doc_id"], row["source"], row["lang"], n, row["text"]]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def tree_of(leaves):
    """Root, and for each leaf the (left, right) siblings from below."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, k in enumerate(at):
            other = level[k ^ 1] if k ^ 1 < len(level) else ""
            paths[i].append((other, "") if k % 2 else ("", other))
        level, at = [sha(*level[i : i + 2]) for i in range(0, len(level), 2)], [k // 2 for k in at]
    return level[0], paths


def brute(rows):
    """Everything of the manifest by plain means."""
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    parts = {}
    for lang in langs:
        trees[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        parts[lang] = tree_of([leaf_of(r) for r in trees[lang]])
    root, tops = tree_of([parts[x][0] for x in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        for r, path in zip(trees[lang], parts[lang][1], strict=True):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            h = leaf_of(r, int(hit))
            for left, right in path + top:
                h = sha(left, h, right)
            out.append((r["doc_id"], leaf_of(r), parts[lang][0], root, sha(*[a + b for a, b in path + top]), h, h == root))
    return sorted(out, key=repr)


def got_of(frame):
    return sorted([tuple(r[k] for k in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in M.verified(frame).collect()], key=repr)


DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("sizes", [[1], [1, 1, 1], [2, 257, 1, 5], [700, 3, 256, 0]])
def test_trees_of_all_sizes(spark, sizes):
    """Lone leaves, full and broken last runs, and trees of more than one bucket of levels."""
    r, rows = random.Random(len(sizes)), []
    for lang, n in zip(["de", None, "en", "é"], sizes, strict=False):
        rows += [(r.randrange(10**6), f"tëxt {i}" if i % 5 else None, lang, "s" if i % 3 else None, i if i % 4 else None) for i in range(n)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, DDL).repartition(5)
    assert got_of(frame) == brute(frame.collect())


def test_odd_rows(odd, none):
    got = got_of(odd)
    assert got == brute(odd.select("doc_id", "text", "lang", "source", "n_chars").collect())
    assert all(v == (i is None or zlib.crc32(str(i).encode()) % 7 != 0 or n is None) for (i, *_, v), n in [(g, {2: None}.get(g[0], 0)) for g in got])
    assert M.verified(none).count() == 0


def test_every_tampered_value_is_noticed(spark):
    """A leaf of any changed field leads to another root; so does a leaf with another's proof."""
    rows = [(i, f"t{i}", "en" if i % 3 else "de", "s", i) for i in range(40)]
    docs = spark.createDataFrame(rows, DDL)
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    proved = M.proofs(docs.withColumn("hash", M.digest(*map(F.col, fields))), F.col("lang"), ["doc_id"], Scratch(spark))
    for name, other in (("doc_id", F.col("doc_id") + 100), ("source", F.lit(None).cast("string")), ("lang", F.lit("fr")), ("text", F.concat("text", F.lit(" "))), ("source", F.lit("s1:"))):
        leaf = M.digest(*[other if f == name else F.col(f) for f in fields])
        assert proved.where(M.folded(leaf, "path") == F.col("root")).isEmpty()
    assert proved.where(M.folded(F.col("hash"), "path") == F.col("root")).count() == 40


def test_nodes_cover_their_leaves(spark):
    leaves = spark.createDataFrame([("=a", i, sha(str(i))) for i in range(300)], "tree string, id long, hash string")
    made = M.build(leaves, ["id"])
    nodes = made.nodes().collect()
    assert sorted((n["level"], n["lo"], n["hi"]) for n in nodes) == sorted((k, lo, min(lo + 2**k, 300)) for k in range(1, 10) for lo in range(0, 300, 2**k))
    assert all(n["kids"][0]["lo"] == n["lo"] and n["kids"][-1]["hi"] == n["hi"] and n["hash"] == sha(*[k["hash"] for k in n["kids"]]) for n in nodes)
