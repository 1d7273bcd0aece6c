import math
from collections import Counter

import numpy as np
import pytest

from snaplake.llm import sampling as s
from snaplake.llm.lattice import Vocabulary


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(s.VOCABULARY)


def every(vocabulary, chunk):
    """All segmentations of a chunk with their probabilities."""
    ids = {p: i for i, p in enumerate(vocabulary.pieces) if np.isfinite(vocabulary.logp[i])}

    def walk(rest):
        if not rest:
            yield ()
        for k in range(1, len(rest) + 1):
            if rest[:k] in ids:
                yield from ((ids[rest[:k]], *more) for more in walk(rest[k:]))

    found = list(walk(chunk))
    w = np.array([vocabulary.logp[list(x)].sum() for x in found])
    return dict(zip(found, np.exp(w - np.logaddexp.reduce(w)), strict=True))


def cut(x, i):
    return tuple(x["ids"][x["offsets"][i] : x["offsets"][i + 1]].tolist())


def encode(vocabulary, texts, k, first=0):
    return s.encode_texts(vocabulary, s.alphabet(vocabulary), texts, np.arange(first, first + len(texts), dtype=np.uint64), k)


def test_law_of_the_samples(vocabulary):
    p, n = every(vocabulary, "▁hello"), 6000
    out = encode(vocabulary, ["hello"] * n, 3)
    rows = [[cut(x, i) for x in out] for i in range(n)]
    assert all(len(set(r)) == 3 for r in rows)
    first, second = Counter(r[0] for r in rows), Counter(r[1] for r in rows)
    for z, q in p.items():
        assert abs(first[z] / n - q) < 4 * math.sqrt(q * (1 - q) / n) + 1e-3
        want = sum(p[a] * q / (1 - p[a]) for a in p if a != z)
        assert abs(second[z] / n - want) < 4 * math.sqrt(want * (1 - want) / n) + 2e-3
    for j, x in enumerate(out):
        assert all(math.isclose(x["log_prob"][i], math.log(p[rows[i][j]]), abs_tol=1e-8) for i in range(200))
    assert (out[0]["perturbed"] > out[1]["perturbed"]).all() and (out[1]["perturbed"] > out[2]["perturbed"]).all()


def test_inclusion_scores_estimate_totals(vocabulary):
    """Horvitz-Thompson: the sum of f / inclusion over a sample estimates the sum of f; here f = p, whose sum is 1."""
    out = encode(vocabulary, ["hello there"] * 4000, 3)
    total = sum(np.where(x["have"], np.exp(x["log_prob"]) / x["inclusion"], 0) for x in out)
    assert abs(total.mean() - 1) < 0.05


def test_all_segmentations_come_out_when_asked(vocabulary):
    p = every(vocabulary, "▁hello")
    out = encode(vocabulary, ["hello", "", "a"], len(p) + 5)
    assert {cut(x, 0) for x in out if x["have"][0]} == set(p) and sum(x["have"][0] for x in out) == len(p)
    assert sum(x["have"][1] for x in out) == 1 and all(np.isclose(x["inclusion"][0], 1) for x in out)


TEXTS = ["", " ", "  two  spaces ", "tab\tline\nend", "▁ own marker ▁▁", "é é 😀 � \x00", "日本語テキスト", "x" * 500, "a " * 300, "́"]


def test_round_trip(spark, vocabulary):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    samples = s.encode(rows, k=3, digests=True)
    got = s.decode(samples.withColumnRenamed("decoded_sha256", "d")).collect()
    assert {r["doc_id"] for r in got} == set(range(len(TEXTS))) and all(r["text"] == TEXTS[r["doc_id"]] for r in got)
    import hashlib

    assert all(r["d"] == hashlib.sha256(TEXTS[r["doc_id"]].encode()).hexdigest() for r in got)


def test_samples_do_not_depend_on_neighbours(vocabulary):
    texts = ["the first text here", "another one", "and the third of them"]
    together = encode(vocabulary, texts, 3)
    for i, t in enumerate(texts):
        alone = encode(vocabulary, [t], 3, first=i)
        assert [cut(x, i) for x in together] == [cut(x, 0) for x in alone]


def test_chunks_are_built_once_and_samples_are_the_same(vocabulary, monkeypatch):
    """What a task has met is looked up, whatever the limit; what it holds has no say in the samples."""
    texts = [t for t in TEXTS if len(t) < 100] + [f"some words {i} of the text 日{chr(0x4E00 + i)}" for i in range(40)]
    keys, letters, built = np.arange(len(texts), dtype=np.uint64), s.alphabet(vocabulary), []
    lattices = s.Lattices
    monkeypatch.setattr(s, "Lattices", lambda v, flat, size: built.append(len(size)) or lattices(v, flat, size))
    want = s.encode_texts(vocabulary, letters, texts, keys, 3)
    distinct, all_held, emptied = sum(built), s.Shelf(vocabulary, letters), s.Shelf(vocabulary, letters, 60)
    for shelf in (all_held, emptied):
        built.clear()
        for _ in range(2):
            for i in range(0, len(texts), 3):
                got = s.encode_texts(vocabulary, letters, texts[i : i + 3], keys[i : i + 3], 3, shelf)
                for x, y in zip(want, got, strict=True):
                    for j, y_has in enumerate(y["have"]):
                        assert y_has == x["have"][i + j] and (not y_has or cut(x, i + j) == cut(y, j) and np.allclose([x[c][i + j] for c in ("log_prob", "perturbed", "inclusion")], [y[c][j] for c in ("log_prob", "perturbed", "inclusion")]))
        assert (sum(built) == distinct) == (shelf is all_held)
    assert all_held.chunks == distinct and emptied.edges < all_held.edges


def test_odd_rows(odd, none):
    got = s.encode(odd).collect()
    by = Counter(r["doc_id"] for r in got)
    assert by[2] == by[3] == 1 and by[1] == 2 * s.TOP_K and by[6] == s.TOP_K
    assert len({tuple(r["ids"]) for r in got if r["doc_id"] == 1}) == s.TOP_K  # equal rows, equal samples
    assert s.encode(none).count() == 0 and s.decode(s.encode(none)).count() == 0


def test_copies_have_samples_of_their_own(spark):
    """Equal rows differ in their samples, wherever a file is cut; the first has those of its id alone."""
    text = "the internationalisation of unbelievable segmentations " * 4
    rows = [(i // 2, text) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    apart = spark.createDataFrame(rows[::2], "doc_id long, text string").coalesce(1)
    own = {(r["doc_id"], r["rank"]): tuple(r["ids"]) for r in s.encode(docs).collect()}
    got = s.encode(docs, copies=True).collect()
    for d in range(4):
        samples = [tuple(r["ids"]) for r in got if r["doc_id"] == d and r["rank"] == 0]
        assert len(samples) == 2 and samples[0] != samples[1] and own[d, 0] in samples
    cut = s.encode(apart.unionByName(apart), copies=True).collect()  # the copies of a document are in two partitions
    assert sorted(map(str, cut)) == sorted(map(str, got))
    assert s.encode(docs.limit(0), copies=True).count() == 0
