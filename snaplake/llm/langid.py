"""Language identification by a string kernel, Nyström landmarks and kernel ridge regression.

A text's features are the hashed character n-grams of 1 to 4 code points that occur in it (blended spectrum, presence only), over
lower-cased text.  The kernel of two texts is the number of shared features over the geometric mean of their numbers.  Landmarks
and training rows are bounded samples, chosen by hash and spread over the languages; one-versus-rest ridge regression on the landmark
kernel gives each language a function of the landmarks.  A batch is scored by two matrix products: features by
landmarks, then landmarks by languages.

Cases: null text and text without a letter are ``und`` with score 0; a null or unlabelled row trains nothing but is predicted;
without training rows every text is ``und``; with one language every text with a letter has it; repeated rows get a row each; empty
tables give empty results; of rows with one ``doc_id`` the least (lang, text) trains; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snaplake.llm import batches as B

FOLDS, HELD = 4, 2
#: Landmarks and training rows, over all languages; ridge; features.
LANDMARKS, TRAINING, RIDGE, FEATURES, LONGEST = 192, 3000, 1e-3, 1 << 14, 4
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id) -> F.Column:
    """Whether a document is in the held-out fold; a null ``doc_id`` is not held out, but trains nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def presence(texts: list[str | None]) -> np.ndarray:
    """Rows of 0 and 1: which features each text has.  The texts' code points go through numpy together."""
    lower = [(t or "").lower() for t in texts]
    out = np.zeros((len(lower), FEATURES), np.float32)
    joined = "".join(lower).encode("utf-32-le", "replace")
    codes = np.frombuffer(joined, np.uint32).astype(np.uint64)
    ends = np.cumsum([len(t) for t in lower])
    row = np.repeat(np.arange(len(lower)), np.diff(ends, prepend=0))
    shift = np.uint64(64 - FEATURES.bit_length() + 1)
    h = np.zeros(len(codes), np.uint64)
    flat = out.ravel()
    for n in range(1, LONGEST + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        inside = row[:m] == row[n - 1 :]
        flat[(row[:m] * FEATURES + ((h * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64))[inside]] = 1.0
    return out


def normalised(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1.0))


class Model:
    """Landmarks (features by landmark) and one weight a landmark and language."""

    def __init__(self, texts: list[str] | np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        """``texts``, or a row of packed :func:`presence` for each."""
        features = lambda at: np.unpackbits(texts[at], axis=1).astype(np.float32) if isinstance(texts, np.ndarray) else presence([texts[i] for i in at])
        self.languages = sorted(set(languages))
        y = np.array([[1.0 if a == b else -1.0 for b in self.languages] for a in languages])
        order = {x: [i for i, a in enumerate(languages) if a == x] for x in self.languages}
        per = max(1, landmarks // max(1, len(self.languages)))
        chosen = [i for x in self.languages for i in order[x][:per]]
        self.landmarks = normalised(features(chosen)).T.copy()
        every = list(range(len(texts)))
        kernel = np.concatenate([self._against(features(every[i : i + 128])) for i in range(0, len(every), 128)])
        inner = kernel[chosen]
        # balanced, so that a common language does not win by being common
        weight = np.array([1.0 / len(order[a]) for a in languages])[:, None]
        left = kernel.T @ (weight * kernel) + ridge * inner + 1e-8 * np.eye(len(chosen))
        self.weights = np.linalg.solve(left, kernel.T @ (weight * y))

    def _kernel(self, texts: list[str]) -> np.ndarray:
        return self._against(presence(texts))

    def _against(self, features: np.ndarray) -> np.ndarray:
        return (normalised(features) @ self.landmarks).astype(np.float64)

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and softmax of the margins."""
        margin = self._kernel(texts) @ self.weights
        e = np.exp(4 * (margin - margin.max(axis=1, keepdims=True)))
        p = e / e.sum(axis=1, keepdims=True)
        best = margin.argmax(axis=1)
        return [self.languages[i] for i in best], p[np.arange(len(best)), best]


def train(docs: DataFrame, rows: int = TRAINING, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on at most ``rows`` labelled rows outside the held-out fold, the same number of each language, chosen by hash.

    Only ids and languages are sorted; the texts of the chosen rows are fetched by a join with their ids, and the driver gets their features: 2 KB a row,
    however long its text.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    languages = own.select("lang").distinct().count()
    per = max(1, rows // max(1, languages))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")  # Spark keeps the first rows of each partition before it shuffles
    ids = [r["doc_id"] for r in own.select("lang", "doc_id").withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= per).select("doc_id").distinct().collect()]
    if not ids:
        return None
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long").distinct()
    got = own.join(F.broadcast(wanted), "doc_id").where(F.col("text").rlike(r"\p{L}")).groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("least"))
    fitted = got.select("doc_id", "least.*").mapInArrow(_packed, "doc_id long, lang string, bits binary").collect()
    fitted.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return Model(np.frombuffer(b"".join(r["bits"] for r in fitted), np.uint8).reshape(len(fitted), -1), [r["lang"] for r in fitted], landmarks) if fitted else None


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each row's text, a bit each."""
    for batch in batches:
        bits = [np.packbits(presence(batch["text"].slice(lo, hi - lo).to_pylist()).astype(np.uint8), axis=1) for lo, hi in _groups(batch["text"])]
        yield pa.record_batch([batch["doc_id"], batch["lang"], pa.array([row.tobytes() for part in bits for row in part], pa.binary())], names=["doc_id", "lang", "bits"])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of each row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = [], []
            ids, texts = batch["doc_id"], batch["text"]
            for lo, hi in _groups(texts):
                part = texts.slice(lo, hi - lo).to_pylist()
                has = [i for i, t in enumerate(part) if t and LETTER.search(t)] if model else []
                names, score = [UNKNOWN] * len(part), np.zeros(len(part))
                if has:
                    best, sure = model.decide([part[i] for i in has])
                    for i, b, s in zip(has, best, sure, strict=True):
                        names[i], score[i] = b, s
                found += names
                scores.append(score)
            yield pa.record_batch([ids, pa.array(found, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def _groups(texts: pa.Array, most: int = 256) -> Iterator[tuple[int, int]]:
    """Runs of at most ``most`` rows and about a MB."""
    for lo, hi, _, _ in B.pieces(texts):
        for a in range(lo, hi, most):
            yield a, min(hi, a + most)
