import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from snaplake.llm import neardup as nd
from snaplake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def prose(r, n):
    return [r.choice("abcdefghij") + r.choice("klmnop") + str(r.randrange(400)) for _ in range(n)]


def edits(r, words, k):
    words = list(words)
    for _ in range(k):
        words[r.randrange(len(words))] = f"e{r.random()}"
    return words


def made(seed=1):
    """Exact copies, near copies about the threshold, chains, short texts, and a passage that many share."""
    r, rows = random.Random(seed), []
    passage = prose(r, 70)
    for g in range(12):
        base = prose(r, r.choice([30, 120, 400]))
        for k in range(r.choice([1, 2, 6])):
            rows.append(" ".join(edits(r, base, k % 4)))
        rows += [" ".join(base)] * r.choice([0, 1, 3])
    chain = prose(r, 200)
    for _ in range(8):
        chain = edits(r, chain, 2)
        rows.append(" ".join(chain))
    rows += [" ".join(prose(r, 40) + passage + prose(r, 60)) for _ in range(40)]
    rows += ["One two", "one TWO", "one two three", "", None, "  \n", "a b c d e", "a b c d  e"]
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def run(spark, rows):
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)


def test_against_brute_force(spark):
    rows = made()
    assert run(spark, rows) == brute(rows)


def test_one_large_group_of_near_copies(spark):
    """More copies than a block, pairwise often below the threshold: all levels, blocks and strips take part."""
    r = random.Random(5)
    base = prose(r, 150)
    rows = [(i, " ".join(edits(r, base, r.randrange(9)))) for i in range(700)] + [(5000 + i, " ".join(prose(r, 100))) for i in range(20)]
    assert run(spark, rows) == brute(rows)


def shared_pages(n, seed=3):
    """Pages of 228 words of which 205 are shared, so that no two of them are similar, and near copies of every 50th."""
    r = random.Random(seed)
    head = prose(r, 205)
    pages = [head + [f"p{i}x{k}" for k in range(23)] for i in range(n)]
    copies = [p[:-3] + ["new", "last", "words"] for p in pages[::50]]
    return [(i, " ".join(p)) for i, p in enumerate(pages + copies)]


def test_group_without_links(spark, monkeypatch):
    """Pages about the threshold: full sets are compared in proportion to their number, and no link among them is lost."""
    sent = {}
    cells = nd._in_cells
    monkeypatch.setattr(nd, "_in_cells", lambda rows, name, scratch: sent.setdefault(name, []).append(rows.count()) or cells(rows, name, scratch))
    for n in (500, 1000):
        rows = shared_pages(n)
        got = {d: c for d, _, c in run(spark, rows)}
        assert got == {i: i if i < n else 50 * (i - n) for i, _ in rows}
    assert sum(v[1] for v in sent.values()) < 2.6 * sum(v[0] for v in sent.values()) and sent["neardup-rest"][1] < 20


def test_cells_of_sketches_refuse_no_similar_pair():
    """In a cell every pair of different parts that is similar goes on to full sets, small and large sets alike."""
    import pandas as pd

    r = np.random.default_rng(4)
    sets = []
    for size in (1, 40, 400, 2300, 2500):
        base = r.integers(0, 1 << 63, size, dtype=np.uint64)
        for k in range(30):
            gone = r.random(size) < k / 200
            sets.append(np.unique(np.where(gone, r.integers(0, 1 << 63, size, dtype=np.uint64), base)))
    rows = pd.DataFrame({"cid": range(len(sets)), "part": [k // 3 for k in range(len(sets))], "n_shingles": [len(v) for v in sets], "fine": [k % 4 for k in range(len(sets))]})
    rows["parities"] = [nd.parities(v) if len(v) < nd.BITS_BELOW else None for v in sets]
    rows["thumb"] = [(nd.B.mix(nd.tokens(v)) & np.uint64(255)).astype(np.uint8).tobytes() if len(v) >= nd.TOKENS_FROM else None for v in sets]
    rows["wide"] = [nd.parities(v, nd.WIDE, 20) for v in sets]
    loose = rows[rows["cid"] % 2 == 1]
    got = set(map(tuple, nd._meeting(pd.concat([rows.assign(loose=False), loose.assign(loose=True)])).to_numpy().tolist()))
    linked = nd.links_of(sets)
    want = {(x % 4, y % 4, c) for x in loose["cid"] for y in rows["cid"] if linked[x, y] and x // 3 != y // 3 for c in (x, y)}
    assert want <= got and len(want) > 300 and len(got) < 1.4 * len(want)


def test_large_sets_at_the_threshold(spark):
    """Sets above the bound of parities are tested by tokens: of pairs just above the threshold nearly all are found, and none below it."""
    r = np.random.default_rng(11)
    rows, want = [], 0
    for i in range(120):
        a = [f"{i}q{k}" for k in range(3000)]
        b = list(a)
        for k in range(int(r.integers(42, 49))):
            b[20 + 60 * k] = f"e{i}x{k}"
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        want += 100 * len(x & y) >= 85 * len(x | y)
    got = run(spark, rows)
    assert 100 < want <= 120 and 0.98 * want <= sum(d != c for d, _, c in got) <= want


def test_links_of_matches_sets():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = [np.unique(r.choice(pool, n)) for n in (5, 80, 200, 200, 150, 1)] + [np.sort(pool[:100]), np.sort(pool[:110])]
    want = [[100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)) for b in sets] for a in sets]
    assert nd.links_of(sets).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, (1 << 64) - 1), min_size=1, max_size=300))
def test_tokens_are_members(values):
    values = np.array(sorted(values), np.uint64)
    t = nd.tokens(values)
    assert len(t) == nd.COORDINATES and np.isin(t, values).all()


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 2600), st.integers(0, 400), st.integers(0, 400), st.integers(0, 9))
def test_sketches_refuse_no_similar_pair(both, left, right, seed):
    """Of small sets whose share is at the threshold or above, every pair passes the test in a leaf."""
    import pyarrow as pa

    values = np.random.default_rng(seed).integers(0, 1 << 63, both + left + right, dtype=np.uint64)
    a, b = np.unique(values[: both + left]), np.unique(np.concatenate([values[:both], values[both + left :]]))
    n = len(np.intersect1d(a, b))
    sizes = [len(a), len(b)]
    thumbs = [(nd.B.mix(nd.tokens(v)) & np.uint64(255)).astype(np.uint8).tobytes() if len(v) >= nd.TOKENS_FROM else None for v in (a, b)]
    rows = pa.table({"node": [1, 1], "cid": [5, 6], "n_shingles": sizes, "parities": pa.array([nd.parities(v) if len(v) < nd.BITS_BELOW else None for v in (a, b)], pa.binary()), "thumb": pa.array(thumbs, pa.binary())})
    found = [p for t in nd._compare(rows) for p in zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True)]
    if 100 * n >= 85 * (sum(sizes) - n):
        assert found == [(5, 6)]
    elif 100 * n < 40 * (sum(sizes) - n):
        assert not found or max(sizes) < 40


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(200, 300), (7, 7)]
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, none):
    got = nd.near_duplicates(odd)
    assert got.count() == odd.count()
    assert {(r["doc_id"], r["component_id"]) for r in got.where("n_shingles = 0").collect()} == {(2, 2), (3, 3), (4, 4)}
    out = nd.deduplicated(odd)
    assert out.columns == odd.columns and sorted(r["doc_id"] or -1 for r in out.collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert nd.near_duplicates(none).count() == 0 and nd.deduplicated(none).count() == 0
