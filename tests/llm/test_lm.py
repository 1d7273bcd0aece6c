import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from snaplake.llm import lm
from snaplake.llm.lattice import MARKER, Lattices, Vocabulary, codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(lm.VOCABULARY)


def sums(vocabulary, word, logp=None):
    """Summed weight of all segmentations, and the expected count of each piece, by enumeration."""
    logp = vocabulary.logp if logp is None else logp
    ids = {p: i for i, p in enumerate(vocabulary.pieces) if np.isfinite(vocabulary.logp[i])}
    total, counts = 0.0, Counter()

    def walk(at, weight, used):
        nonlocal total
        if at == len(word):
            total += weight
            for p in used:
                counts[p] += weight
            return
        single = ids.get(word[at])
        if single is None:
            spelled = [int(vocabulary.bytes[b]) for b in word[at].encode()]
            walk(at + 1, weight * math.exp(logp[spelled].sum()), used + spelled)
        for k in range(at + 1, len(word) + 1):
            if word[at:k] in ids:
                i = ids[word[at:k]]
                walk(k, weight * math.exp(logp[i]), [*used, i])

    walk(0, 1.0, [])
    return math.log(total), {p: c / total for p, c in counts.items()}


WORDS = [MARKER + w for w in ("the", "hello", "éréier", "x", "ab", "😀", "naïve", "ing", "q" * 9)]


def test_lattice(vocabulary):
    flat, lengths = codes(WORDS)
    lattices = Lattices(vocabulary, flat, lengths)
    want = [sums(vocabulary, w) for w in WORDS]
    assert np.allclose(lattices.log_probabilities(), [t for t, _ in want])
    times = np.arange(1, len(WORDS) + 1)
    counts = lattices.expected_counts(times)
    expected = np.zeros(len(vocabulary.pieces))
    for n, (_, c) in zip(times, want, strict=True):
        for p, x in c.items():
            expected[p] += n * x
    assert np.allclose(counts, expected)
    assert math.isclose(np.exp(vocabulary.logp).sum(), 1.0)


def corpus():
    base = "the quick brown fox jumps over the lazy dog and runs on".split()
    return [(i, " ".join(base[(i * j) % 12] + ("" if j % 7 else str(i % 5)) for j in range(1, 40))) for i in range(300)]


def test_scores(spark, vocabulary):
    rows = [*corpus(), (1000, None), (1001, ""), (1002, "Zebra naïve THE")]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).collect()}
    train = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 10}
    words = {d: WORD.findall((t or "").translate(LOW)) for d, t in rows}
    counts = Counter(w for d in train for w in words[d])
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    for d, _ in rows:
        r = got[d]
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(counts[w] for w in words[d]), len(train)])
        assert math.isclose(r["base_score"], base) and r["n_tokens"] == len(words[d]) + 1 and r["train_tokens"] == n
        assert r["n_known"] == sum(w in counts for w in words[d]) + 1 and r["held_out"] == (d not in train)
    # the model itself, from the same parts: one round of expected counts over the training words, then the marginal
    pieces = np.zeros(len(vocabulary.pieces))
    for w, k in counts.items():
        for p, x in sums(vocabulary, MARKER + w)[1].items():
            pieces[p] += k * x
    pieces[vocabulary.end] += len(train)
    with np.errstate(divide="ignore"):
        logp = np.log((1 - lm.PRIOR) * pieces / pieces.sum() + lm.PRIOR * np.exp(vocabulary.logp))
    for d in (0, 7, 1001, 1002):
        spelled = [sums(vocabulary, MARKER + w, logp)[0] for w in words[d]]
        score = (sum(spelled) + logp[vocabulary.end]) / math.log(10)
        mixed = sum(math.log10((counts[w] + v * math.exp(x)) / (n + v)) for w, x in zip(words[d], spelled, strict=True))
        mixed += math.log10((len(train) + v * math.exp(logp[vocabulary.end])) / (n + v))
        assert math.isclose(got[d]["score"], score, rel_tol=1e-9) and math.isclose(got[d]["mixture_score"], mixed, rel_tol=1e-9)


def test_vocabulary_alone(spark, vocabulary):
    """Without rounds the score is the marginal under the vocabulary's own scores."""
    got = lm.score(spark.createDataFrame([(1, "Hello the naïve"), (2, "x")], "doc_id long, text string"), rounds=0).collect()
    for r in got:
        words = {1: ["hello", "the", "naïve"], 2: ["x"]}[r["doc_id"]]
        want = sum(sums(vocabulary, MARKER + w)[0] for w in words) + vocabulary.logp[vocabulary.end]
        assert math.isclose(r["score"], want / math.log(10), rel_tol=1e-9)


def test_long_word_in_linear_time(vocabulary):
    flat, lengths = codes([MARKER + "abcdefgh" * 5000])
    began = time.perf_counter()
    value = Lattices(vocabulary, flat, lengths).log_probabilities()[0]
    assert math.isfinite(value) and time.perf_counter() - began < 12


def test_held_out_text_is_likelier_than_noise(spark):
    rows = corpus()
    noise = [(900_000, "xqzj vkkq zzjx qqvv jxkz kvqz zxqv")]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.score(spark.createDataFrame(rows + noise, "doc_id long, text string")).collect()}
    assert min(v for d, v in got.items() if d < 900_000) > got[900_000]


def test_odd_rows(odd, none):
    got = lm.score(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    assert lm.score(none).count() == 0
