import random
import zlib

import numpy as np
import pytest

from snaplake.llm import batches as B
from snaplake.llm import toxicity as T

CLEAN = "river garden window letter music winter market bridge candle forest silver morning travel kitchen paper summer".split()
BAD = "blockhead nitwit scoundrel".split()
CHANGES = [lambda w: w, str.upper, lambda w: w + "s", lambda w: w[:2] + w[1:], lambda w: w[:-1] + "!", lambda w: "x" + w]


def docs(n=1200, seed=4):
    """Texts of 20 to 80 words, every sixth with some bad words in changed spellings; those of the held-out fold have spellings that none else has."""
    r, out = random.Random(seed), []
    for i in range(n):
        words = [r.choice(CLEAN) + r.choice(["", "s", "ed", "ing"]) for _ in range(r.randrange(20, 80))]
        toxic = int(i % 6 == 0)
        for _ in range(3 * toxic):
            word = r.choice(BAD)
            words.insert(r.randrange(len(words)), word[:3] + "zz" + word[3:] if zlib.crc32(str(i).encode()) % 3 == 1 else r.choice(CHANGES)(word))
        out.append((i, " ".join(words), toxic))
    return out


def frames(spark, rows):
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


@pytest.mark.parametrize("texts", [["Ab cde, fgh!\nIJ", "", None, "é", "naïve—café 12345"], ["a"], ["  ", "\n"]])
def test_features_are_the_words_and_their_ngrams(texts):
    """Every n-gram of three to five with at most an edge at its ends, and every word, once for each place."""
    got = [[] for _ in texts]
    for f, rows in T.subwords(texts):
        for x, k in zip(f.tolist(), rows.tolist(), strict=True):
            got[k].append(x)
    edge = lambda c: c in "— 　" or (ord(c) < 128 and not c.isalnum())
    shift = np.uint64(64 - T.BITS)
    for text, have in zip(texts, got, strict=True):
        codes = [0, *(0 if edge(c) else ord(c) for c in (text or "").lower()), 0]
        want = []
        for n in (3, 4, 5):
            for i in range(len(codes) - n + 1):
                part = codes[i : i + n]
                if all(part[1:-1]):
                    h = np.array([part[0]], np.uint64)
                    for k in range(1, n):
                        h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(part[k]) + np.uint64(k + 1)
                    want.append(int(B.mix(h)[0] >> shift))
        i = 0
        while i < len(codes):
            j = i
            while j < len(codes) and codes[j]:
                j += 1
            if j > i:
                want.append(int(B.run_hashes(np.array(codes, np.uint64), np.array([i]), np.array([j]))[0] >> shift))
            i = max(j, i + 1)
        assert sorted(have) == sorted(want)


def test_a_score_is_the_softmax_of_the_mean():
    rows = docs(120)
    model = T.Model([t for _, t, _ in rows], [y for *_, y in rows], steps=60)
    alone = [model.score([t])[0] for _, t, _ in rows[:20]]
    assert np.allclose(model.score([t for _, t, _ in rows[:20]]), alone)
    f = np.concatenate([x for x, _ in T.subwords([rows[0][1]])])
    margin = sum(model.table[k] for k in f) / (sum(model.weights[k] for k in f) + model.neutral) + model.bias
    assert np.isclose(alone[0], 1 / (1 + np.exp(-(model.slope * margin + model.shift))))
    loss = lambda m: -np.mean([np.log(p if y else 1 - p) for p, (*_, y) in zip(m.score([t for _, t, _ in rows]), rows, strict=True)])
    assert loss(model) < loss(T.Model([t for _, t, _ in rows], [y for *_, y in rows], steps=2))


def test_gradient():
    """One step from zero embeddings is the gradient of the weighted loss, found by differences."""
    r = np.random.default_rng(1)
    place, value, bounds, y = np.array([0, 1, 1, 2]), np.array([1.0, 0.5, 2.0, 1.0], np.float32), np.array([0, 2, 4]), np.array([0, 1])
    softmax = (np.random.default_rng(7).normal(size=(T.DIMENSION, 2)) / np.sqrt(T.DIMENSION)).astype(np.float32)

    def loss(embedding):
        z = np.stack([embedding[0] + 0.5 * embedding[1], 2 * embedding[1] + embedding[2]]) @ softmax.astype(float)
        return np.mean([np.log(np.exp(z[i]).sum()) - z[i, y[i]] for i in range(2)])

    step = np.zeros((3, T.DIMENSION))
    for k in np.ndindex(step.shape):
        e = np.zeros_like(step)
        e[k] = 1e-4
        step[k] = -(loss(e) - loss(-e)) / 2e-4
    old, T.BATCH = T.BATCH, 2
    try:
        got, _ = T._descend(place, value, bounds, y, np.arange(2), 3, 1, 7)
    finally:
        T.BATCH = old
    g = softmax[:, 1] - softmax[:, 0]
    assert np.allclose(np.sign(got), np.sign(step @ g)) and np.allclose(got, step @ g, rtol=0.35)


def test_unseen_spellings_of_the_held_out_fold(spark):
    rows = docs()
    frame, labels = frames(spark, rows)
    got = {r["doc_id"]: r["score"] for r in T.score(frame, T.train(frame, labels)).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 150 and all(0 <= s <= 1 for s, _ in held)
    bad, good = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    assert np.mean(bad >= T.THRESHOLD) > 0.8 and np.mean(good >= T.THRESHOLD) < 0.01  # 0.86 and 0 when written
    assert np.mean(bad[:, None] > good) > 0.98


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    rows = docs(240)
    frame, labels = frames(spark, rows)
    other = [(i, t, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, t, y in rows]
    a, b = T.train(frame, labels), T.train(frame.repartition(5), frames(spark, other)[1])
    assert np.array_equal(a.table, b.table) and a.bias == b.bias and (a.slope, a.shift) == (b.slope, b.shift)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (6, 0), (7, 1), (8, None), (None, 1), (99, 1), (2, 1), (3, 0)], "doc_id long, toxic int")
    model = T.train(odd, labels)
    got = T.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3, 4)}) == 1
    assert T.train(none, labels) is None and T.train(odd, labels.limit(0)) is None
    assert {r["score"] for r in T.score(odd, None).collect()} == {0.0} and T.score(none, model).count() == 0
