"""Toxicity by subword bags: character n-gram embeddings, averaged into a linear softmax and trained jointly with it.

A text's features are its words and the character n-grams of 3 to 5 code points in them (with the words' edges), lower-cased and hashed to buckets.  A bag is the mean of
the features' embeddings, each weighted by ``RARE / (RARE + frequency)`` so that frequent subwords don't drown the others, over the sum of weights and a constant that
keeps short texts near the middle.  Embeddings and softmax are trained by stochastic gradient descent with momentum in numpy, on a bounded sample of
labelled rows; a fifth of the sample is kept from it and calibrates the score.  A misspelling that no training text holds shares
most n-grams with what it was made from.

Softmax and mean are linear, so a model scores with one number a bucket: the embedding's product with the difference of the two classes' weights.

Cases: null and empty texts, and texts without letters or digits, have the score of an empty bag; a null or unlabelled row trains nothing; of several labels of one id the
greatest counts, and of several texts the least one trains; without rows of both labels every score is 0; repeated rows get a row each; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snaplake.llm import batches as B

FOLDS, HELD = 3, 1
#: Rows of each label that train at most, and words of each (evenly spread over the text; words of over LONG characters are left out of training).
TRAINING, WORDS, LONG = 2000, 1000, 64
#: Features, embedding size, steps of BATCH rows, rate, momentum, least training texts of a feature.
BITS, DIMENSION, STEPS, BATCH, RATE, MOMENTUM, LEAST = 17, 8, 400, 64, 1.0, 0.9, 3
RARE, NEUTRAL = 1e-4, 0.3
SHORTEST, LONGEST = 3, 5
THRESHOLD = 0.7

_EDGE = np.array([not chr(c).isalnum() for c in range(128)])
_NEXT = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id) -> F.Column:
    """Whether a document is in the held-out fold; a null ``doc_id`` is not held out, but trains nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def subwords(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row of the text) of all n-grams of each length, and of all words."""
    lower = [(t or "").lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(lower) + "\n").encode("utf-32-le", "replace"), np.uint32)
    row = np.concatenate([[0], np.repeat(np.arange(len(lower)), [len(t) + 1 for t in lower])])
    edge = ((codes < 128) & _EDGE[np.minimum(codes, 127)]) | ((codes >= 0x2000) & (codes < 0x2070)) | (codes == 0xA0) | (codes == 0x3000)
    codes = np.where(edge, 0, codes).astype(np.uint64)
    edges = np.concatenate([[0], np.cumsum(edge)])
    shift, h = np.uint64(64 - BITS), codes
    for n in range(2, LONGEST + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * _NEXT + codes[n - 1 :] + np.uint64(n)
        if n >= SHORTEST:
            inside = edges[n - 1 : n - 1 + m] == edges[1 : m + 1]  # an edge may only be the first or the last of an n-gram
            yield (B.mix(h[inside]) >> shift).astype(np.int64), row[1 : m + 1][inside]
    starts, ends = np.flatnonzero(~edge[1:] & edge[:-1]) + 1, np.flatnonzero(edge[1:] & ~edge[:-1]) + 1
    yield (B.run_hashes(codes, starts, ends) >> shift).astype(np.int64), row[starts]


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the features of each text, by row and bucket, in 4 bytes each."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.int32, np.int32, np.float32)]
    for a in range(0, len(texts), 32):
        keys, n = np.unique(np.concatenate([(r + a << BITS) + f for f, r in subwords(texts[a : a + 32])]), return_counts=True)
        for part, values in zip(parts, (keys >> BITS, keys & ((1 << BITS) - 1), n), strict=True):
            part.append(values.astype(part[0].dtype))
    rows, features, counts = (np.concatenate(parts.pop(0)) for _ in range(3))  # a list goes before the next one is copied
    return rows, features, counts


class Model:
    """Jointly trained embeddings and softmax, folded into one number a bucket; ``weights`` are the features' shares in the mean."""

    def __init__(self, texts: list[str], labels: list[int], steps: int = STEPS, seed: int = 7):
        y = np.array(labels)
        rows, features, counts = counted(texts)
        times = np.bincount(features, weights=counts, minlength=1 << BITS)
        self.weights = np.where(np.bincount(features, minlength=1 << BITS) >= LEAST, RARE / (RARE + times / max(1.0, times.sum())), 0.0)
        share = counts
        share *= self.weights.astype(np.float32)[features]  # 0 for rare features
        total = np.bincount(rows, weights=share, minlength=len(y))
        self.neutral = max(NEUTRAL * float(np.median(total)), 1e-9)
        share /= (total + self.neutral).astype(np.float32)[rows]
        scale = 1 / max(1e-9, np.sqrt(np.mean(np.bincount(rows, weights=share**2, minlength=len(y)))))
        share *= np.float32(scale)
        bounds = np.searchsorted(rows, np.arange(len(y) + 1))
        del rows
        used = np.flatnonzero(self.weights)
        place = np.zeros(1 << BITS, np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        calibrating = np.arange(len(y)) % 5 == 4
        embedded, self.bias = _descend(place[features], share, bounds, y, np.flatnonzero(~calibrating), max(1, len(used)), steps, seed)
        self.table = np.zeros(1 << BITS)
        self.table[used] = embedded[: len(used)] * scale * self.weights[used]
        self.slope, self.shift = 1.0, 0.0
        if len({*y[calibrating].tolist()}) == 2:
            self.slope, self.shift = _calibrated(self.margins([t for t, c in zip(texts, calibrating, strict=True) if c]), y[calibrating])

    def margins(self, texts: list[str | None]) -> np.ndarray:
        sums, total = np.zeros(len(texts)), np.full(len(texts), self.neutral)
        for f, rows in subwords(texts):
            sums += np.bincount(rows, weights=self.table[f], minlength=len(texts))
            total += np.bincount(rows, weights=self.weights[f], minlength=len(texts))
        return sums / total + self.bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -30, 30)))


def _descend(place: np.ndarray, value: np.ndarray, bounds: np.ndarray, y: np.ndarray, rows: np.ndarray, features: int, steps: int, seed: int) -> tuple[np.ndarray, float]:
    """What each feature adds to label 1 against 0, and the bias, after ``steps`` batches; both labels weigh the same in all."""
    random = np.random.default_rng(seed)
    embedding, softmax, bias = np.zeros((features, DIMENSION), np.float32), (random.normal(size=(DIMENSION, 2)) / np.sqrt(DIMENSION)).astype(np.float32), np.zeros(2, np.float32)
    moves = [np.zeros_like(embedding), np.zeros_like(softmax), np.zeros_like(bias)]
    weight = 0.5 / np.maximum(np.bincount(y[rows], minlength=2) / max(1, len(rows)), 1e-9)
    order = np.zeros(0, np.int64)
    for _ in range(steps if len(rows) else 0):
        while len(order) < BATCH:
            order = np.concatenate([order, random.permutation(rows)])
        batch, order = order[:BATCH], order[BATCH:]
        batch = batch[bounds[batch + 1] > bounds[batch]]
        if not len(batch):
            continue
        size = bounds[batch + 1] - bounds[batch]
        first = np.cumsum(size) - size
        at = np.repeat(bounds[batch] - first, size) + np.arange(size.sum())
        f, v = place[at], value[at][:, None]
        bag = np.add.reduceat(embedding[f] * v, first, axis=0)
        z = bag @ softmax + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(batch)), y[batch]] -= 1
        g = (p * weight[y[batch]][:, None] / len(batch)).astype(np.float32)
        for move in moves:
            move *= MOMENTUM
        back = np.repeat(g @ softmax.T, size, axis=0) * v
        for k in range(DIMENSION):
            moves[0][:, k] += np.bincount(f, weights=back[:, k], minlength=features)
        moves[1] += bag.T @ g
        moves[2] += g.sum(axis=0)
        embedding -= RATE * moves[0]
        softmax -= 0.1 * RATE * moves[1]
        bias -= 0.1 * RATE * moves[2]
    return embedding @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0])


def _calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, the best of a grid; both labels weigh the same, and both are drawn to 1 and 0."""
    weight = (0.5 / np.maximum(np.bincount(y, minlength=2), 1))[y]
    found = []
    for slope in 2.0 ** np.arange(-2, 2.5, 0.5):
        for shift in np.arange(-3, 3.25, 0.25):
            loss = np.logaddexp(0, np.where(y == 1, -1, 1) * (slope * margins + shift))
            found.append((float(np.sum(weight * loss)) + (np.log(slope) ** 2 + shift**2) / len(y), float(slope), float(shift)))
    return min(found)[1:]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING) -> Model | None:
    """Fit on at most ``rows`` rows of each label outside the held-out fold, chosen by hash; None if a label has none.

    Only ids and labels are joined and ranked; the chosen rows' words are fetched by a join with their ids.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    by_hash = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")  # Spark keeps the first rows of each partition before it shuffles
    there = known.join(own.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = [(r["doc_id"], r["toxic"]) for r in there.withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= rows).select("doc_id", "toxic").collect()]
    if len({toxic for _, toxic in chosen}) < 2:
        return None
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int")  # at most twice ``rows``
    words = F.filter(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.length(w) <= LONG)
    spread = F.transform(F.array(words), lambda ws: F.filter(ws, lambda w, i: F.pmod(F.xxhash64(i), F.greatest(F.size(ws), F.lit(1))) < WORDS))
    texts = own.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "toxic", F.array_join(F.get(spread, 0), " ").alias("text"))
    got = texts.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return Model([r["text"] for r in got], [r["toxic"] for r in got])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` of each row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0)]
            for lo, hi, _, _ in B.pieces(batch["text"]):
                parts.append(model.score(batch["text"].slice(lo, hi - lo).to_pylist()) if model else np.zeros(hi - lo))
            yield pa.record_batch([batch["doc_id"], pa.array(np.concatenate(parts), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
