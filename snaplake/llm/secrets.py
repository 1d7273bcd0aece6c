"""Secret scans: fixed patterns, and a character convolutional network over every candidate in its context.

Candidates are runs of at least ``MIN_CANDIDATE`` key-like characters that hold a digit, a change from small to capital letters, or
``LONG_LETTERS`` characters (a shorter run of letters in one case is a word).  The network (numpy: embedding, one convolution, pooling
over the candidate and over its context, two dense layers) sees 32 characters before, the candidate and 16 after; a candidate
of more than 64 characters is seen whole in successive windows, of which the highest score counts.

It is trained on all distinct labelled findings: secrets are candidates that the fixed patterns confirm, the others are candidates
that can't be secrets (words, numbers, dates, paths, version names).  What is neither is only scored.  Training goes by rounds, one Spark job
each: findings are dealt to shards of some ``SHARD`` of each label (the rarer label is repeated until both are as many), each shard takes Adam steps
over all of its findings from the network of the round before, and the next network is the mean of what the shards made of it.  So that the network learns the
shape of keys and not the patterns, the words before most training secrets are blanked or taken from another finding, and copies of them change case,
alphabet and length; negatives get copies made of dates, numbers and words of the corpus.  A fourth of the findings, by hash, is held out: their scores, each
in four forms with and without the words before it, are counted by thousandths of a logit, and Platt's method and the threshold come from these
counts; the threshold is the highest that keeps ``MIN_RECALL`` of the held-out secrets in all forms, however low it is.  The recall and precision of
held-out findings at the threshold are kept with the network and logged.

The network names the key itself (kind ``cnn``), also where a fixed pattern has found it with the words around it.

Cases: null and empty texts have no findings; without findings of both labels there is no network and only the fixed patterns
count; repeated rows get a row each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm import spans as S
from snaplake.storage import Scratch, stored

LOG = logging.getLogger(__name__)
KINDS = ["assign", "access", "hex", "cnn"]
# The patterns that define base findings, and the least length of each.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

MIN_CANDIDATE, LONG_LETTERS = 8, 20
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % MIN_CANDIDATE)
MARKED = re.compile(r"[0-9]|[a-z][A-Z]|[A-Za-z0-9+/_=.-]{%d}" % LONG_LETTERS)
#: A part of a value that is no key: a word, a capital word, a number, a few digits after a word, words joined by capitals.
ORDINARY = re.compile(r"[A-Z]?[a-z]*|[A-Z]*|[0-9]*|[A-Za-z][a-z]*[0-9]{1,4}|[a-z]{3,}(?:[A-Z][a-z]{2,})+|(?:[A-Z][a-z]{2,})+")
JOINTS = re.compile(r"[+/_=.-]+")
BEFORE, SPAN, AFTER = 32, 64, 16
WIDTH = BEFORE + SPAN + AFTER
MIN_RECALL = 0.98
#: Findings of each label in a shard, Adam steps that a shard takes in all rounds together, and rows of a step of either label.
SHARD, STEPS, HALF = 4096, 600, 32
KEY_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", np.uint8)
#: What stands in place of a secret.
MARK = "[secret]"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the fixed patterns find.  Each pattern is tried only where a character that it needs occurs."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]
    return S.ordered(found, KINDS)


#: A maximal run of at least the least length: the same matches as all runs, of which the short ones fail.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{%d,}" % MIN_HEX)


def views(text: str, start: int, end: int) -> list[bytes]:
    """The network's views of a candidate, one for each 64 characters, one byte a character; other alphabets are all one symbol."""
    flat = (text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[start : end + AFTER]).encode("ascii", "replace").replace(b"\x7f", b"?")
    out = []
    for lo in range(0, end - start, SPAN):
        size = min(SPAN, end - start - lo)
        at = BEFORE + lo + size
        out.append(flat[lo : lo + BEFORE] + flat[BEFORE + lo : at].ljust(SPAN, b"\0") + flat[at : at + AFTER].ljust(AFTER, b"\0"))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Candidates of a text; dots and dashes at the ends belong to the sentence."""
    out = []
    if MARKED.search(text):
        for m in RUN.finditer(text):
            value = m[0]
            if MARKED.search(value):
                a, b = m.start() + len(value) - len(value.lstrip(".-=")), m.end() - (len(value) - len(value.rstrip(".-")))
                if b - a >= MIN_CANDIDATE and MARKED.search(text, a, b):
                    out.append((a, b))
    return out


def ordinary(value: str) -> bool:
    """Whether a value can't be a secret: all of its parts are words or numbers."""
    return all(ORDINARY.fullmatch(part) for part in JOINTS.split(value))


FINDING = "array<struct<start: int, end: int, label: int, views: array<binary>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finding = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.int32()), ("views", pa.list_(pa.binary()))]))
    for batch in batches:
        base, found = [], []
        for text in batch["text"]:
            text = text.as_py() or ""
            spans = base_spans(text)
            base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
            taken = S.Taken(spans)
            found.append([{"start": a, "end": b, "label": 1 if not taken.clear(a, b) else 0 if ordinary(text[a:b]) else None, "views": views(text, a, b)} for a, b in candidates(text)])
        yield pa.record_batch([batch["doc_id"], pa.array(base, pa.list_(S.SPAN)), pa.array(found, finding)], names=["doc_id", "base", "found"])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, base spans, and every candidate with its views and label (null: neither), of each whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, f"doc_id long, base array<{S.SPAN_DDL}>, found {FINDING}")


class CharCNN:
    """Embedding of 8, 24 filters of width 5; the highest and the mean over the candidate, and the highest over its context."""

    EMBED, FILTERS, REACH, HIDDEN = 8, 24, 5, 16

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.3, (128, self.EMBED)),
            "w": r.normal(0, 0.2, (self.REACH * self.EMBED, self.FILTERS)),
            "b": np.zeros(self.FILTERS),
            "u": r.normal(0, 0.2, (3 * self.FILTERS, self.HIDDEN)),
            "c": np.zeros(self.HIDDEN),
            "v": r.normal(0, 0.2, self.HIDDEN),
            "d": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.recall = self.precision = float("nan")

    def _forward(self, x: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        kind = p["e"].dtype
        cols = np.lib.stride_tricks.sliding_window_view(p["e"][x], self.REACH, axis=1)  # row, place, embedding, offset
        cols = cols.transpose(0, 1, 3, 2).reshape(len(x), -1, self.REACH * self.EMBED)
        act = np.maximum(cols @ p["w"] + p["b"], 0)
        half = self.REACH // 2
        here = x[:, half:-half] != 0
        place = np.arange(half, WIDTH - half)
        own = (place >= BEFORE) & (place < BEFORE + SPAN)
        inner, outer = (here & own).astype(kind)[:, :, None], (here & ~own).astype(kind)[:, :, None]
        mine, around = act * inner, act * outer
        top, edge = mine.argmax(axis=1), around.argmax(axis=1)
        size = np.maximum(inner.sum(axis=1), 1)
        at = lambda a, i: np.take_along_axis(a, i[:, None], 1)[:, 0]
        pooled = np.concatenate([at(mine, top), mine.sum(axis=1) / size, at(around, edge)], axis=1)
        hidden = np.maximum(pooled @ p["u"] + p["c"], 0)
        return {"cols": cols, "act": act, "inner": inner, "outer": outer, "top": top, "edge": edge, "size": size, "pooled": pooled, "hidden": hidden, "logit": hidden @ p["v"] + p["d"][0]}

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return np.concatenate([self._forward(x[i : i + 256], p)["logit"] for i in range(0, len(x), 256)]).astype(float) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -50, 50)))

    def highest(self, found: list[list[bytes]]) -> np.ndarray:
        """The probability of each candidate: the highest of its windows."""
        if not found:
            return np.zeros(0)
        counts = np.array([len(v) for v in found])
        p = self.probability(as_rows([w for v in found for w in v]))
        return np.maximum.reduceat(p, np.cumsum(counts) - counts)

    def _gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self._forward(x, self.p)
        dl = (1 / (1 + np.exp(-np.clip(f["logit"], -50, 50))) - y) * weight / len(x)
        g = {"v": f["hidden"].T @ dl, "d": np.array([dl.sum()])}
        dh = np.outer(dl, p["v"]) * (f["hidden"] > 0)
        g |= {"u": f["pooled"].T @ dh, "c": dh.sum(axis=0)}
        dp = dh @ p["u"].T
        n, places, k = f["act"].shape
        da = f["inner"] * (dp[:, k : 2 * k] / f["size"])[:, None, :]
        rows, cols = np.meshgrid(np.arange(n), np.arange(k), indexing="ij")
        da[rows, f["top"], cols] += dp[:, :k] * f["inner"][rows, f["top"], 0]
        da[rows, f["edge"], cols] += dp[:, 2 * k :] * f["outer"][rows, f["edge"], 0]
        da *= f["act"] > 0
        g |= {"w": f["cols"].reshape(-1, f["cols"].shape[-1]).T @ da.reshape(-1, k), "b": da.sum(axis=(0, 1))}
        dc = (da @ p["w"].T).reshape(n, places, self.REACH, self.EMBED)
        # the gradient of an embedding is the sum over its places
        code = np.concatenate([x[:, o : o + places].ravel() for o in range(self.REACH)])
        each = np.concatenate([dc[:, :, o].reshape(-1, self.EMBED) for o in range(self.REACH)])
        de = np.stack([np.bincount(code, each[:, j], len(p["e"])) for j in range(self.EMBED)], axis=1)
        return g | {"e": de}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, rate: float = 0.01, seed: int = 7) -> None:
        """Adam over ``steps`` batches of ``HALF`` secrets and ``HALF`` others, each a new :func:`copies` of them; all of either are taken in turn."""
        r, m, v = np.random.default_rng(seed), {}, {}
        yes, no = x[y == 1], x[y == 0]
        plain = plain_values(no, r)
        labels = np.repeat([1.0, 0.0], HALF)
        order = [np.concatenate([r.permutation(len(k)) for _ in range(-(-steps * HALF // len(k)))]) for k in (yes, no)]
        for t in range(1, steps + 1):
            a, b = (o[(t - 1) * HALF : t * HALF] for o in order)
            batch = np.concatenate(copies(yes[a], no[b], plain, r))
            for k, g in self._gradient(batch, labels, np.ones(2 * HALF)).items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def flat(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([v.ravel() for v in self.p.values()])

    def with_flat(self, flat: np.ndarray) -> CharCNN:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, min_recall: float) -> None:
        """:meth:`calibrated` on the scores of findings."""
        self.calibrated(self.logits(x), y, np.ones(len(y)), min_recall)

    def calibrated(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, min_recall: float) -> None:
        """Platt's two parameters by Newton steps, then the highest threshold that keeps ``min_recall`` of the secrets; ``n`` findings have score ``z`` and label ``y``."""
        a, b = 1.0, 0.0
        secrets, others = float(n @ y), float(n @ (1 - y))
        target = np.where(y == 1, (secrets + 1) / (secrets + 2), 1 / (others + 2))
        loss = lambda a, b: float(np.sum(n * (np.logaddexp(0, a * z + b) - target * (a * z + b))))
        for _ in range(100):
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
            w, e = n * q * (1 - q), n * (q - target)
            h = np.array([[np.sum(w * z * z) + 1e-9, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-9]])
            g = np.array([np.sum(e * z), np.sum(e)])
            step, t, now = np.linalg.solve(h, g), 1.0, loss(a, b)
            while t > 1e-10 and loss(a - t * step[0], b - t * step[1]) > now - 1e-4 * t * (g @ step):
                t /= 2  # a whole step overshoots where scores are far apart, and then all scores saturate
            a, b = a - t * step[0], b - t * step[1]
            if np.abs(t * step).max() < 1e-6:
                break
        self.scale, self.shift = float(a), float(b)
        p = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -50, 50)))
        order = np.flatnonzero(y == 1)
        order = order[np.argsort(p[order])]
        self.threshold = float(p[order][np.searchsorted(np.cumsum(n[order]), np.floor((1 - min_recall) * secrets), side="right")]) if secrets else 1.1
        self.threshold -= min(1e-9, self.threshold / 2)  # the same score summed in another order is not below it
        found = p >= self.threshold
        self.recall = float(n @ (found & (y == 1)) / secrets) if secrets else float("nan")
        self.precision = float(n @ (found & (y == 1)) / (n @ found)) if found.any() else float("nan")


def as_rows(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(found), np.uint8).reshape(-1, WIDTH)


def plain_values(no: np.ndarray, r: np.random.Generator, n: int = 2000) -> list[bytes]:
    """Values that are no secrets, made of numbers and of the words in and around the findings ``no``."""
    words = sorted({w for row in no for w in re.findall(rb"[A-Za-z]{3,12}", row.tobytes())}) or [b"word"]
    word = lambda: words[r.integers(len(words))]
    digits = lambda k: b"".join(b"%d" % d for d in r.integers(0, 10, k))
    made = []
    for i in range(n):
        joint = [b"-", b"/", b"_", b".", b"="][r.integers(5)]
        kind = i % 6
        if kind == 0:
            value = digits(int(r.integers(8, 20)))
        elif kind == 1:
            value = b"%d-%02d-%02dT%02d" % (r.integers(1900, 2100), r.integers(1, 13), r.integers(1, 29), r.integers(24))
        elif kind == 2:
            value = joint.join(word() for _ in range(r.integers(2, 7)))
        elif kind == 3:
            value = joint.join(word() if r.random() < 0.6 else digits(int(r.integers(1, 5))) for _ in range(r.integers(2, 7)))
        elif kind == 4:
            value = word().lower() + b"".join(word().title() for _ in range(r.integers(1, 4)))
        else:
            value = b"".join(word() for _ in range(r.integers(2, 5)))
            value = value.lower() if r.random() < 0.5 else value.upper()
        made.append(value[:SPAN].ljust(SPAN, b"\0") if len(value) >= MIN_CANDIDATE else (value + digits(MIN_CANDIDATE)).ljust(SPAN, b"\0"))
    return made


def copies(yes: np.ndarray, no: np.ndarray, plain: list[bytes], r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Changed copies of findings: other case, alphabet and length, other values, other words before them or none."""
    yes, no = yes.copy(), no.copy()
    value = slice(BEFORE, BEFORE + SPAN)
    for row in yes:
        kind = r.random()
        if kind < 0.25:
            row[value] = np.where((row[value] >= 97) & (row[value] <= 122), row[value] - 32, row[value])
        elif kind < 0.75:
            letters = KEY_LETTERS[: r.choice([36, 62, 64])] if r.random() < 0.8 else KEY_LETTERS[26:62]
            size = int(r.integers(16, SPAN + 1))
            row[value] = 0
            row[BEFORE : BEFORE + size] = letters[r.integers(len(letters), size=size)]
        elif kind < 0.85:
            row[BEFORE + int(r.integers(20, SPAN + 1)) : BEFORE + SPAN] = 0
    for row in no:
        if r.random() < 0.6:
            row[value] = np.frombuffer(plain[r.integers(len(plain))], np.uint8)
    # a third of the secrets keep their context, a third have another finding's and a third none; quotes are around either
    other, which = no[r.integers(len(no), size=len(yes))], r.random((len(yes), 1))
    for part in (slice(0, BEFORE), slice(BEFORE + SPAN, WIDTH)):
        yes[:, part] = np.where(which < 1 / 3, yes[:, part], np.where(which < 2 / 3, other[:, part], 0))
        no[r.random(len(no)) < 1 / 3, part] = 0
    for rows, may in ((yes, which[:, 0] >= 1 / 3), (no, np.ones(len(no), bool))):
        quoted = may & (r.random(len(rows)) < 1 / 4)
        rows[quoted, BEFORE - 1] = rows[quoted, BEFORE + SPAN] = 34
    return yes, no


def forms(x: np.ndarray, y: np.ndarray, seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Held-out findings as they are, without their context, and as two changed copies."""
    r = np.random.default_rng(seed)
    bare = x.copy()
    bare[:, :BEFORE] = bare[:, BEFORE + SPAN :] = 0
    yes, no = x[y == 1], x[y == 0]
    xs, ys = [x, bare], [y, y]
    if len(yes) and len(no):
        plain = plain_values(no, r)
        for _ in range(2):
            xs += copies(yes, no, plain, r)
            ys += [np.ones(len(yes)), np.zeros(len(no))]
    return np.concatenate(xs), np.concatenate(ys)


def train(scanned: DataFrame, min_recall: float = MIN_RECALL, shard: int = SHARD, steps: int = STEPS) -> CharCNN | None:
    """Fit on all distinct labelled findings (the first window of a long one), of which every fourth by hash is held out for calibration."""
    scratch = Scratch(scanned.sparkSession)
    seen = scanned.select(F.explode("found").alias("f")).where("f.label IS NOT NULL").select("f.label", F.col("f.views")[0].alias("view")).distinct()
    seen = scratch.stored(seen.withColumn("held", F.pmod(F.xxhash64("view"), F.lit(4)) == 0), "secret-findings")
    n = {(r["label"], r["held"]): r["count"] for r in seen.groupBy("label", "held").count().collect()}
    fit = [n.get((label, False), 0) for label in (0, 1)]
    if not all(fit):
        scratch.drop()
        return None
    most = max(fit)
    shards = -(-most // shard)
    # the rarer label is repeated, so that every shard has about as many of either
    times = F.when(F.col("label") == 0, -(-most // fit[0])).otherwise(-(-most // fit[1]))
    dealt = seen.where("NOT held").withColumn("copy", F.explode(F.sequence(F.lit(1), times))).withColumn("shard", F.pmod(F.xxhash64("view", "copy", F.lit("shard")), F.lit(shards)))
    dealt = scratch.stored(dealt.select("shard", "copy", "label", "view"), "secret-shards")
    each = max(-(-min(most, shard) // HALF), 1)  # steps in which a shard sees all of its findings
    rounds = max(3, round(steps / each))
    if shards == 1:  # one shard has nothing to wait for
        rounds, each = 2, max(each, steps // 2)
    net = CharCNN()
    for i in range(rounds):
        net = _round(dealt, net, each, 0.01 if i < rounds / 2 else 0.003, i)
    net.calibrated(*_scores(seen.where("held"), net, -(-(n.get((0, True), 0) + n.get((1, True), 0)) // shard) or 1), min_recall)
    scratch.drop()
    LOG.info("secrets: threshold %.4g, held-out recall %.4f, precision %.4f of %s findings", net.threshold, net.recall, net.precision, n)
    return net


def _findings(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Views and labels of a shard, in an order that does not depend on how its rows came."""
    keys = [(k, "ascending") for k in ("label", "view", "copy") if k in table.column_names]
    table = table.sort_by(keys)
    return as_rows(table["view"].to_pylist()), table["label"].to_numpy().astype(float)


def _round(dealt: DataFrame, net: CharCNN, steps: int, rate: float, number: int) -> CharCNN:
    """The mean of what each shard makes of ``net``; a shard without one of the labels has no say."""
    start = net.flat()

    def shard(key: tuple, table: pa.Table) -> pa.Table:
        x, y = _findings(table)
        own = CharCNN().with_flat(start)
        if 0 < y.sum() < len(y):
            own.fit(x, y, steps, rate, seed=number * 1_000_003 + key[0].as_py())
            return pa.table({"weights": pa.array([own.flat()], pa.list_(pa.float64()))})
        return pa.table({"weights": pa.array([], pa.list_(pa.float64()))})

    made = dealt.groupBy("shard").applyInArrow(shard, "weights array<double>").select(F.posexplode("weights").alias("at", "w"))
    # sums of decimals don't depend on their order
    mean = made.groupBy("at").agg((F.sum(F.col("w").cast("decimal(28,14)")).cast("double") / F.count("*")).alias("w")).orderBy("at").collect()
    return CharCNN().with_flat(np.array([r["w"] for r in mean])) if mean else net


def _scores(held: DataFrame, net: CharCNN, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, label and number of held-out findings in all :func:`forms`, scores cut down to thousandths: their number does not grow with the input."""

    def score(key: tuple, table: pa.Table) -> pa.Table:
        x, y = forms(*_findings(table), seed=8 + key[0].as_py())
        z = np.floor(np.clip(net.logits(x), -60, 60) * 1000).astype(np.int64)
        return pa.table({"z": z, "label": y.astype(np.int32)})

    dealt = held.withColumn("shard", F.pmod(F.xxhash64("view", F.lit("held")), F.lit(shards)))
    rows = dealt.groupBy("shard").applyInArrow(score, "z long, label int").groupBy("z", "label").count().orderBy("z", "label").collect()
    return tuple(np.array([r[c] for r in rows], float) / d for c, d in (("z", 1000), ("label", 1), ("count", 1)))


def find_secrets(docs: DataFrame, **training) -> DataFrame:
    """``doc_id, base, spans``: base spans, and all spans with the network's (kind ``cnn``), of each row.

    The texts are read once; candidates go to a written table, which the network is trained on and then scores.
    """
    scanned = stored(scan(docs), "secret-candidates")
    net = train(scanned, **training)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = batch["base"].to_pylist(), batch["found"].to_pylist()
            flat = [f for row in found for f in row] if net is not None else []
            sure = iter((net.highest([f["views"] for f in flat]) >= net.threshold).tolist() if flat else [])
            spans = []
            for own, row in zip(base, found, strict=True):
                all_ = [(s["kind"], s["start"], s["end"]) for s in own]
                all_ += [("cnn", f["start"], f["end"]) for f in row if next(sure, False)]
                spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in S.ordered(all_, KINDS)])
            yield pa.record_batch([batch["doc_id"], batch["base"], pa.array(spans, pa.list_(S.SPAN))], names=["doc_id", "base", "spans"])

    return scanned.mapInArrow(score, f"doc_id long, base array<{S.SPAN_DDL}>, spans array<{S.SPAN_DDL}>")


def span_text(column: str) -> F.Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", **training) -> DataFrame:
    """``docs`` with every found secret replaced by ``MARK``; all rows and columns stay.

    A first pass trains the network; the second finds and cuts row by row, so that no text is shuffled.
    """
    scratch = Scratch(docs.sparkSession)
    net = train(scratch.stored(scan(docs.select("doc_id", F.col(text).alias("text"))), "secret-candidates"), **training)
    scratch.drop()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch[text]:
                value = value.as_py()
                if value:
                    spans = base_spans(value)
                    spans += network_spans(net, value)
                    done, parts = 0, []
                    for _, a, b in S.ordered(spans, KINDS):
                        if b > done:
                            parts += [value[done:a], MARK if a >= done else ""]
                            done = b
                    value = "".join(parts) + value[done:]
                out.append(value)
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(cut, docs.schema)


def network_spans(net: CharCNN | None, text: str) -> list[tuple[str, int, int]]:
    """What the network finds in one text."""
    found = candidates(text) if net is not None else []
    sure = net.highest([views(text, *c) for c in found]) if found else []
    return [("cnn", *c) for c, q in zip(found, sure, strict=True) if q >= net.threshold]
