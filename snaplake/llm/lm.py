"""LM scoring: the marginal probability of a text over all subword segmentations.

The model is a unigram model over the pieces of an existing vocabulary.  A text is its words (A-Z lowered) and one end; a word's
probability is the sum over its segmentations, by a forward recursion in log space, and a text's is the product.  The
vocabulary's scores weight the segmentations; ``ROUNDS`` rounds of expectation maximisation over the training documents tune them as
priors of the pieces, in which the vocabulary's own scores keep the weight of ``PRIOR`` of all expected pieces (0 rounds keep them
as they are).  The pieces themselves never change.  All probabilities of pieces add up to one, so those of texts do too, but for
segmentations that cross words.

Beside it stands ``mixture_score``: one more arc for the whole word as the corpus knows it, ``p(word) = (count + V * lattice(word)) /
(N + V)``.

Every text is read once.  Blocks of a few MB of text become one row: the distinct words of the block, and the
documents as numbers into them.  The words of blocks are dealt by word once, counted there, weighed there and dealt back to
their blocks; a word that is everywhere is one row a block.  The number of partitions follows the number of blocks.

Cases: null and empty texts are one end; a null ``doc_id`` is held out; without training documents N is 0, V is 0 and the base spreads
evenly; repeated rows are counted and scored row by row; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snaplake.llm import batches as B
from snaplake.llm.lattice import MARKER, OWN_MARKER, Lattices, Vocabulary, codes
from snaplake.storage import Scratch, stored

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, ROUNDS = 10, 2
#: Share of the expected pieces that the vocabulary's own scores are worth.
PRIOR = 0.1
BLOCK_BYTES = 6 << 20
#: Distinct words whose lattices are built at once.
WORDS_AT_ONCE = 50_000


def held_out(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = {"words": pa.list_(pa.string()), "counts": pa.list_(pa.int64()), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "tokens": pa.binary(), "ends": pa.int64()}
    for batch in batches:
        lo = 0
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while lo < batch.num_rows:
            hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + BLOCK_BYTES, "right"))))
            ids = batch["doc_id"].slice(lo, hi - lo).to_pylist()
            hashes, lengths, where = [], [], []
            for _, _, data, offsets in B.pieces(batch["text"].slice(lo, hi - lo)):
                data = B.lower_ascii(data)
                starts, ends, rows = B.word_spans(data, offsets)
                hashes.append(B.span_hashes(data, starts, ends))
                lengths.append(np.bincount(rows, minlength=len(offsets) - 1))
                where.append((data.tobytes(), starts, ends))
            hashes, lengths = np.concatenate(hashes), np.concatenate(lengths)
            _, first, tokens = np.unique(hashes, return_index=True, return_inverse=True)
            begin = np.cumsum([0, *(len(w[1]) for w in where)])
            part = np.searchsorted(begin, first, "right") - 1
            words = []
            for k, i in zip(part.tolist(), (first - begin[part]).tolist(), strict=True):
                data, starts, ends = where[k]
                words.append(data[starts[i] : ends[i]].decode("utf-8", "replace"))
            train = np.array([not held_out(i) for i in ids])
            counts = np.bincount(tokens[np.repeat(train, lengths)], minlength=len(words)).astype(np.int64)
            packed = pa.compress(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)
            row = {"words": [words], "counts": [counts], "doc_ids": [ids], "lengths": [lengths.astype(np.int64)], "tokens": [packed], "ends": [int(train.sum())]}
            yield pa.record_batch([pa.array(row[k], t) for k, t in fields.items()], names=list(fields))
            lo = hi


def blocks(docs: DataFrame) -> DataFrame:
    """Numbered blocks of documents, written."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks, "words array<string>, counts array<long>, doc_ids array<long>, lengths array<long>, tokens binary, ends long")
    return stored(rows.withColumn("block", F.monotonically_increasing_id()), "lm-blocks")


def word_lattices(vocabulary: Vocabulary, words: list[str], logp: np.ndarray | None = None) -> Iterator[tuple[int, int, Lattices]]:
    """Lattices of runs of ``words``, a marker before each; a marker inside a word is spelled in bytes."""
    for lo in range(0, len(words), WORDS_AT_ONCE):
        run = words[lo : lo + WORDS_AT_ONCE]
        flat, lengths = codes([MARKER + w for w in run])
        flat = np.where(flat == ord(MARKER), OWN_MARKER, flat)
        flat[np.cumsum(lengths) - lengths] = ord(MARKER)
        yield lo, lo + len(run), Lattices(vocabulary, flat, lengths, logp)


def fit(words: DataFrame, ends: int, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces after ``rounds`` over ``word, c``: each word as often as training documents have it.

    Spark sums the expected counts of pieces; the driver gets a row a piece.
    """
    logp = vocabulary.logp
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], logp=logp) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(len(logp))
            for batch in batches:
                times = batch["c"].to_numpy().astype(float)
                for lo, hi, lattices in word_lattices(vocabulary, batch["word"].to_pylist(), logp):
                    counts += lattices.expected_counts(times[lo:hi])
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(at), pa.array(counts[at])], names=["piece", "n"])

        sums = words.mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(len(logp))
        counts[sums["piece"].to_numpy(np.int64)] = sums["n"].to_numpy()
        counts[vocabulary.end] += ends
        if not counts.sum():
            break
        share = (1 - PRIOR) * counts / counts.sum() + PRIOR * np.exp(vocabulary.logp)
        logp = np.where(share > 0, np.log(np.maximum(share, 1e-300)), -np.inf)
    return logp


def mixture(c: np.ndarray, spelled: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 of (count + V * lattice) / (N + V), with the lattice's natural log; the lattice alone if nothing was seen."""
    if not n:
        return spelled / np.log(10)
    with np.errstate(divide="ignore"):
        return (np.logaddexp(np.log(c), np.log(v) + spelled) - np.log(n + v)) / np.log(10)


def _weigh(vocabulary: Vocabulary, logp: np.ndarray):
    """``block, at, c, spelled`` of rows ``block, at, word, c``: each distinct word of a batch has one lattice."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.dictionary_encode(batch["word"])
            distinct = words.dictionary.to_pylist()
            value = np.zeros(len(distinct))
            for lo, hi, lattices in word_lattices(vocabulary, distinct, logp):
                value[lo:hi] = lattices.log_probabilities()
            yield pa.record_batch([batch["block"], batch["at"], batch["c"], pa.array(value[words.indices.to_numpy(zero_copy_only=False)])], names=["of", "at", "c", "spelled"])

    return weigh


def score(docs: DataFrame, path: str = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixture_score`` of each row, log10.

    ``base_score`` is the smoothed count of each word; ``score`` the lattice's marginal.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary(path)
    cut = blocks(docs)
    sums = cut.agg(F.count("*").alias("blocks"), F.sum("ends").alias("ends")).first()
    ends, parts = sums["ends"] or 0, max(int(spark.conf.get("spark.sql.shuffle.partitions")), sums["blocks"])
    entries = cut.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "e")).select("block", "at", F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    by_word = Window.partitionBy("word").orderBy("block")
    whole = by_word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = entries.repartition(parts, "word").select("block", "at", "word", F.sum("n").over(whole).alias("c"), (F.row_number().over(by_word) == 1).alias("first"))
    scratch = Scratch(spark)
    counted = scratch.stored(counted, "lm-words")
    known = counted.where("first AND c > 0").select("word", "c")
    totals = known.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (totals["n"] or 0) + ends, totals["v"] + (1 if ends else 0)
    logp = fit(known, ends, vocabulary, rounds)
    weighed = counted.select("block", "at", "word", "c").mapInArrow(_weigh(vocabulary, logp), "of long, at int, c long, spelled double")
    end_base, end_spelled = np.log10((ends + 0.1) / (n + 0.1 * (v + 1))), float(logp[vocabulary.end])
    end_mixture = float(mixture(np.array([ends]), np.array([end_spelled]), n, v)[0])
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mixture_score double"
    names = [x.split()[0] for x in schema.split(", ")]

    def total(block: pa.Table, table: pa.Table) -> pa.Table:
        parts = []
        at = table["at"].to_numpy()
        c, spelled = np.zeros(len(at)), np.zeros(len(at))
        c[at], spelled[at] = table["c"].to_numpy(), table["spelled"].to_numpy()
        base, mixed = np.log10((c + 0.1) / (n + 0.1 * (v + 1))), mixture(c, spelled, n, v)
        for row in block.to_pylist():
            lengths = np.array(row["lengths"], np.int64)
            raw = pa.decompress(row["tokens"], decompressed_size=4 * int(lengths.sum()), codec="zstd", asbytes=True)
            tokens = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(lengths)])
            add = lambda x: np.add.reduceat(np.append(x[tokens], 0.0), edges[:-1]) * (lengths > 0)  # noqa: B023, E731
            ids = row["doc_ids"]
            columns = [pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids]), pa.array(lengths + 1), pa.array(add((c > 0).astype(float)).astype(np.int64) + (ends > 0)), pa.array(np.full(len(ids), n))]
            columns += [pa.array(add(base) + end_base), pa.array((add(spelled) + end_spelled) / np.log(10)), pa.array(add(mixed) + end_mixture)]
            parts.append(pa.table(columns, names=names))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())], names=names)

    left = cut.select("block", "doc_ids", "lengths", "tokens").repartition(parts, "block").groupBy("block")
    return left.cogroup(weighed.repartition(parts, "of").groupBy("of")).applyInArrow(total, schema)
