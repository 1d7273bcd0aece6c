import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from snaplake.llm import secrets as s
from snaplake.llm.spans import Taken


def brute(text):
    a = [("assign", m.start(), m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    b = [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    c = [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(a + b + c, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


parts = st.lists(st.sampled_from(["token", "API_KEY", "Secret", ": ", " = ", '"', "'", "AKIA", "AB12CD34EF56", "abcdef0123456789", "x", " ", "é", "😀", "K"]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(parts)
def test_base(text):
    assert s.base_spans(text) == brute(text)


def key(r, n=40):
    return "".join(r.choice(list("0123456789abcdef"), n))


def docs_of(n, seed=3):
    r = np.random.default_rng(seed)
    words = ["alpha", "beta", "gamma", "delta"]
    out = []
    for i in range(n):
        prose = " ".join(r.choice(words, 12))
        kind = i % 4
        mid = f'token = "{key(r)}"' if kind == 0 else f"id {r.integers(10**15, 10**16)}" if kind == 1 else f"page-{i}-of-the-book-12" if kind == 2 else "none"
        out.append((i, f"{prose} {mid} {prose}"))
    return out


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Forms of keys that no fixed pattern names, and of values that are no keys.
KEYS = {"mixed": (LETTERS, 32), "capital hex": ("0123456789ABCDEF", 40), "short hex": ("0123456789abcdef", 24), "letters only": (LETTERS[:52], 28), "long": (LETTERS + "+/", 150)}
OTHERS = ["2024-03-17T10:22", "9807915762804490", "/usr/share/doc/README.html", "getUserAccountName", "release-2.14.3-beta2", "mail7.example.com", "192.168.100.211", "ISO-9001-2:2015", "978-3-16-148410-0", "state-of-the-art-2020"]


def test_network_finds_unnamed_keys(spark):
    """Keys planted in forms that no fixed pattern names are found, and dates, paths, numbers and names are not."""
    docs = docs_of(400)
    r = np.random.default_rng(9)
    word = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta"], 8))
    planted = {1000 + i: "".join(r.choice(list(letters), n)) for i, (letters, n) in enumerate(list(KEYS.values()) * 20)}
    others = {2000 + i: v for i, v in enumerate(OTHERS * 10)}
    rows = docs + [(d, f"{word()} {v} {word()}") for d, v in (planted | others).items()]
    text = dict(rows)
    got = {f["doc_id"]: f for f in s.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and all([tuple(x) for x in got[d]["base"]] == brute(t) for d, t in rows)
    found = {d: [text[d][x["start"] : x["end"]] for x in f["spans"] if x["kind"] == "cnn"] for d, f in got.items()}
    recall = sum(v in found[d] for d, v in planted.items()) / len(planted)
    wrong = sum(bool(found[d]) for d in others)
    assert recall >= 0.8 and wrong <= 0.05 * len(others), (recall, wrong)
    named = [d for d, t in docs if "token" in t]
    assert sum(bool(found[d]) for d in named) >= 0.9 * len(named)  # what the patterns find, the network finds by itself
    assert not any(found[d] for d, t in docs if "token" not in t)


def test_long_candidates_are_seen_whole():
    text = "say " + "k1" * 100 + " end"
    (c,) = s.candidates(text)
    seen = s.views(text, *c)
    assert c == (4, 204) and len(seen) == 4 and {len(v) for v in seen} == {s.WIDTH}
    assert b"".join(v[s.BEFORE : s.BEFORE + s.SPAN].rstrip(b"\0") for v in seen).decode() == "k1" * 100
    assert seen[1][: s.BEFORE] == ("k1" * 16).encode() and seen[3][-s.AFTER :].rstrip(b"\0") == b" end"


def test_long_runs_take_linear_time():
    net = s.CharCNN()
    for text in ("a" * 10**6, "1" * 10**6, "aB" * 500_000, "a1," * 300_000, "token = " * 100_000, "AKIA" * 200_000):
        began = time.perf_counter()
        s.base_spans(text)
        s.network_spans(net, text)
        assert time.perf_counter() - began < 20


def test_taken():
    r = np.random.default_rng(4)
    for _ in range(200):
        spans = [("k", int(a), int(a + n)) for a, n in zip(r.integers(0, 50, 5), r.integers(1, 9, 5), strict=True)]
        a = int(r.integers(0, 50))
        b = a + int(r.integers(1, 9))
        assert Taken(spans).clear(a, b) == all(b <= x or a >= y for _, x, y in spans)


def test_gradient():
    net, r = s.CharCNN(), np.random.default_rng(0)
    x, y, w = r.integers(0, 128, (6, s.WIDTH)), r.integers(0, 2, 6).astype(float), np.ones(6)
    g = net._gradient(x, y, w)

    def loss():
        z = net._forward(x, net.p)["logit"]
        return np.mean(np.log1p(np.exp(z)) - y * z)

    for k in ("w", "u", "v", "d", "e"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        net.p[k][at] += 1e-6
        up = loss()
        net.p[k][at] -= 2e-6
        assert abs((up - loss()) / 2e-6 - g[k][at]) < 1e-4
        net.p[k][at] += 1e-6


def test_threshold_keeps_recall():
    """Secrets that are rare and look like the rest score low; the threshold follows them down."""
    net, r = s.CharCNN(), np.random.default_rng(5)
    x, y = r.integers(32, 127, (1000, s.WIDTH)), (np.arange(1000) < 50).astype(float)
    net.calibrate(x, y, 0.98)
    p = net.probability(x)
    assert p[y == 1].max() < 0.5
    assert net.recall == (p[y == 1] >= net.threshold).mean() >= 0.98
    assert net.precision == y[p >= net.threshold].mean()


def test_calibration_does_not_saturate():
    """Scores that lie apart stay apart after calibration, so the recall threshold parts them."""
    net, z = s.CharCNN(), np.concatenate([[0.47, 2.28], np.full(35, 2.98), np.linspace(-15, -7, 165), [-0.39]])
    net.logits = lambda x: z
    y = (z > 0).astype(float)
    net.calibrate(np.zeros((len(z), 1)), y, 0.98)
    assert net.scale < 100 and net.recall == net.precision == 1


def test_redaction(spark):
    secret = "0123456789abcdef" * 3
    docs = spark.createDataFrame([(1, f"a token = {secret} b", 7), (2, None, 8), (3, "clean", 9)], "doc_id long, text string, extra int")
    got = {r["doc_id"]: r["text"] for r in s.redact(docs).collect()}
    assert got == {1: f"a {s.MARK} b", 2: None, 3: "clean"} and s.redact(docs).columns == docs.columns


def test_odd_rows(odd, none):
    got = s.find_secrets(odd)
    assert got.count() == odd.count() and s.find_secrets(none).count() == 0
    assert s.redact(odd).count() == odd.count() and s.redact(odd).columns == odd.columns and s.redact(none).count() == 0


def test_every_finding_is_learnt_from(spark, monkeypatch):
    """All distinct findings are in a shard or held out, and each shard has both labels, however many shards there are."""
    scanned = s.scan(spark.createDataFrame(docs_of(400), "doc_id long, text string"))
    distinct = {(f["label"], bytes(f["views"][0])) for r in scanned.collect() for f in r["found"] if f["label"] is not None}
    dealt, held, round_, scores = [], [], s._round, s._scores

    def one_round(rows, net, *rest):
        if not dealt:
            dealt.extend(rows.collect())
        return round_(rows, net, *rest)

    monkeypatch.setattr(s, "_round", one_round)
    monkeypatch.setattr(s, "_scores", lambda rows, *rest: (held.extend(rows.collect()), scores(rows, *rest))[1])
    net = s.train(scanned, shard=30, steps=4)
    fitted, out = ({(r["label"], bytes(r["view"])) for r in rows} for rows in (dealt, held))
    assert fitted | out == distinct and not fitted & out and len(distinct) > 250
    shards = {k: {r["label"] for r in dealt if r["shard"] == k} for k in {r["shard"] for r in dealt}}
    assert len(shards) > 3 and all(v == {0, 1} for v in shards.values())
    again = s.train(scanned, shard=30, steps=4)
    assert (net.flat() == again.flat()).all() and net.threshold == again.threshold
