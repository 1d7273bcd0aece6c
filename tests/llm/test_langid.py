import zlib

import numpy as np

from snaplake.llm import langid

VOCAB = {
    "en": "the of and to in that with this there when which their would about other".split(), "de": "der die und das nicht ein ich auch sich mit für über wäre schon".split(),
    "fr": "le la les des est dans pour que qui été être avec mais où très".split(), "es": "el los las que por una con para está también más año señor".split(),
}


def docs(n=160, seed=2):
    r = np.random.default_rng(seed)
    names = list(VOCAB)
    return [(i, " ".join(r.choice(VOCAB[names[i % 4]], r.integers(5, 60))), names[i % 4]) for i in range(n)]


def kernel(a, b):
    grams = lambda t: {t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}
    a, b = grams(a.lower()), grams(b.lower())
    return len(a & b) / np.sqrt(len(a) * len(b))


def test_kernel_is_the_spectrum_kernel():
    texts = [t for _, t, _ in docs(12)]
    x = langid.normalised(langid.presence(texts))
    want = np.array([[kernel(a, b) for b in texts] for a in texts])
    assert np.abs(x @ x.T - want).max() < 0.05  # hashing may merge a few features
    alone = np.concatenate([langid.presence([t]) for t in texts])
    assert (langid.presence(texts) == alone).all()  # neighbours in a batch don't matter


def test_ridge_is_the_plain_solution():
    """Weights and margins against a solution by loops over the kernel of texts."""
    rows = docs(40)
    texts, langs = [t for _, t, _ in rows], [x for *_, x in rows]
    model = langid.Model(texts, langs, landmarks=12, ridge=0.01)
    names = sorted(set(langs))
    chosen = [i for x in names for i in [j for j, a in enumerate(langs) if a == x][:3]]
    k = np.array([[kernel(t, texts[c]) for c in chosen] for t in texts])
    w = np.array([1 / langs.count(a) for a in langs])
    y = np.array([[1.0 if a == x else -1.0 for x in names] for a in langs])
    left = sum(w[i] * np.outer(k[i], k[i]) for i in range(len(k))) + 0.01 * k[chosen] + 1e-8 * np.eye(len(chosen))
    margin = k @ np.linalg.solve(left, sum(w[i] * np.outer(k[i], y[i]) for i in range(len(k))))
    got = model._kernel(texts) @ model.weights
    assert (got.argmax(axis=1) == margin.argmax(axis=1)).mean() > 0.95 and np.abs(got - margin).mean() < 0.1


def test_repeated_ids_train_alike(spark):
    """Of rows with one doc_id the same one trains in every run."""
    rows = docs(40) + [(i, t + " x", "zz") for i, t, _ in docs(40)]
    a, b = (langid.train(spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(n)) for r, n in ((rows, 3), (rows[::-1], 5)))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_held_out_accuracy(spark):
    rows = docs(400)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(frame, langid.train(frame, rows=200, landmarks=40)).collect()}
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 60 and np.mean([got[i]["lang_pred"] == x for i, x in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    rows = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, t, x in docs(200)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(VOCAB)


def test_odd_rows(spark, odd, none):
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(odd, langid.train(odd)).collect()}
    assert {(2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0)} <= got
    assert langid.train(none) is None and langid.identify(none, None).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}
    one = spark.createDataFrame([(1, "only one", "en"), (5, "1234", "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(one, langid.train(one)).collect()} == {1: "en", 5: "und"}
