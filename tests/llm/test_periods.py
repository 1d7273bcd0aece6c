import random
import zlib

import numpy as np
import pytest

from snaplake.llm import batches as B
from snaplake.llm import periods as P


def brute(words):
    """Every stretch of every period by comparing words, the least period of equal stretches."""
    best = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in best.items()), key=lambda r: (r[0], r[2]))


def text_of(r):
    kinds, size, words = r.choice([1, 2, 3, 5, 50]), r.choice([0, 1, 23, 24, 25, 90, 300, 700]), []
    while len(words) < size:
        what = r.random()
        if what < 0.3:
            words += [r.randrange(kinds) for _ in range(r.randrange(1, 40))]
        elif what < 0.7 or not words:
            unit = [r.randrange(kinds) for _ in range(r.randrange(1, r.choice([4, 12, 40, 120])))]
            words += (unit * r.randrange(2, 9))[: r.randrange(1, 400)]
        else:
            a = r.randrange(len(words))
            words += words[a : a + r.randrange(1, 200)] * r.randrange(1, 4)
    return words


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b


def test_all_runs_of_texts_together():
    r, found = random.Random(11), 0
    for _ in range(25):
        texts = [text_of(r) for _ in range(8)] + [fibonacci(r.randrange(300)) * r.randrange(1, 5)]
        bounds = np.cumsum([0, *map(len, texts)])
        got = P.runs_of(B.mix(np.array([x for t in texts for x in t], np.uint64)), bounds)
        assert got == [brute(t) for t in texts]
        found += sum(map(len, got))
    assert found > 1000


@pytest.mark.parametrize("q", [1, 8, 9, 12, 13, 18, 19, 27, 28, 500])
def test_a_run_at_the_limits(q):
    """Of exactly the least length, one word less, and with a strange word on each side."""
    least = max(24, 3 * q)
    for n, want in ((least, [(2, least, q)]), (least - 1, [])):
        words = np.array([10**6, 10**7, *[i % q for i in range(n)], 10**8], np.uint64)
        assert P.runs_of(B.mix(words), np.array([0, len(words)])) == [want]


def test_strongest_is_exact_and_first():
    assert P.strongest([(5, 30, 10), (0, 27, 9), (0, 24, 8), (90, 27, 9)]) == (5, 30, 10)
    assert P.strongest([(0, 3 * (10**9 + 1) + 1, 10**9 + 1), (7, 3 * 10**9 + 1, 10**9)])[2] == 10**9
    assert P.strongest([]) is None


def test_query_by_plain_means(spark):
    from snaplake.llm import queries

    r = random.Random(3)
    rows = [(i, " ".join(f"w{x}" for x in text_of(r))) for i in range(40)] + [(i, " \n ".join(f"u{j}é" for j in range(60 + i))) for i in range(40, 80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x["doc_id"]: x for x in P.periodic_runs(P.planted(frame)).withColumn("runs_text", P.runs_text("runs")).collect()}
    changed = 0
    for i, text in rows:
        words, h = text.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, changed = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)], changed + 1
        runs = brute(words)
        assert [tuple(x) for x in out[i]["runs"]] == runs
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        assert out[i]["collapsed"] == " ".join(w for k, w in enumerate(words) if k not in gone)
        assert out[i]["runs_text"] == "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    assert changed > 3 and "op11_periodic_runs" in queries.QUERIES


def test_odd_rows(odd, none):
    got = P.periodic_runs(P.planted(odd)).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["runs"] == [] and by_id[i]["collapsed"] == "" and by_id[i]["strongest"] is None for i in (2, 3, 4))
    assert [tuple(r) for r in by_id[6]["runs"]] == [(0, 40_000, 1)] and by_id[6]["collapsed"] == "ab"
    assert by_id[5]["collapsed"] == "x" * 30_000
    assert P.periodic_runs(P.planted(none)).count() == 0
