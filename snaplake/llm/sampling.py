"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement.

A text's segmentations have the probabilities of the unigram lattice (see :mod:`snaplake.llm.lattice`).  The best ``TOP_K`` of their
log probabilities plus Gumbel noise are a sample without replacement.  They are found by a perturbed A-star search: the
root holds all segmentations and its perturbed maximum; taking a node with the highest maximum yields its best
segmentation and splits the rest by the first decision (an edge into a lattice node, chunk by chunk) at which it
leaves that segmentation, each part with a Gumbel maximum truncated at the node's.  Bounds are exact, so the first k nodes taken
are the k samples.  All texts of a piece of a batch advance together in numpy.

Each sample has its log probability, its perturbed value, and its inclusion probability given the next value below the sample:
``1 - exp(-exp(log_prob - next))``, which is 1 if there is none.

Noise is a hash of the row's key, the round and the place, so a row's samples don't depend on its neighbours or on partitioning.

Cases: null and empty texts have one segmentation, without pieces; a text with fewer than ``TOP_K`` segmentations has as many samples; rows
that are equal have equal samples; a null key is a key; any character that has no piece is spelled in bytes, so decoding gives
back every text exactly; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snaplake.llm import batches as B
from snaplake.llm.lattice import MARKER, OWN_MARKER, Lattices, Vocabulary

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TOP_K = 3
PIECE_BYTES = 1 << 19
#: Edges of lattices that a task keeps, 24 bytes each and 4 for each node.
EDGES = 6_000_000
SAMPLES = "doc_id long, rank int, ids array<int>, log_prob double, perturbed double, inclusion double"


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as each count, one after another."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def stream(seed: np.ndarray, *parts: int) -> np.ndarray:
    """Seeds of one purpose: a hash of each row's seed and ``parts``."""
    for p in parts:
        seed = B.mix(seed * np.uint64(0x2545F4914F6CDD1D) + np.uint64(p + 1))
    return seed


def uniform(seed: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1), a hash of a seed and a place."""
    h = B.mix(seed + np.asarray(place).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Shelf:
    """Lattices of the chunks that a task has met, so that a chunk that comes again is looked up and not built again.

    A chunk's edges lie together, end by end, so a walk finds all of a chunk in one place.  A node is the number of the first edge that
    ends in it, the root is -1; ``upto`` sums the shares of a node's edges, and has no end at the last.  What is held has no
    say in a sample: a chunk's lattice is the same wherever it is built.  Once there are ``limit`` edges, all are dropped
    before the next texts, so memory is bounded by these and what one piece of texts adds.
    """

    def __init__(self, vocabulary: Vocabulary, alphabet: np.ndarray, limit: int = EDGES):
        self.vocabulary, self.alphabet, self.limit = vocabulary, alphabet, limit
        self.first_edge = np.zeros(1, np.int32)
        self.origin, self.piece = np.empty(0, np.int32), np.empty(0, np.int32)
        self.share, self.upto = np.empty(0), np.empty(0)
        self.clear()

    def clear(self) -> None:
        self.keys, self.finals = np.zeros(1 << 12, np.uint64), np.full(1 << 12, -1, np.int32)
        self.chunks = self.nodes = self.edges = 0
        self.spelled: dict[tuple[int, ...], int] = {}
        self.spelling, self.spelling_size = np.zeros((0, 4), np.int32), np.zeros(0, np.int64)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """The last node of each chunk, -1 where it is not held."""
        shift, last = np.uint64(64 - len(self.keys).bit_length() + 1), len(self.keys) - 1
        at = (hashes >> shift).astype(np.int64)
        out = self.finals[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != hashes))
        at = at[open_]
        while len(open_):
            at = (at + 1) & last
            now = self.finals[at]
            out[open_] = now
            on = (now >= 0) & (self.keys[at] != hashes[open_])
            open_, at = open_[on], at[on]
        return out

    def _enter(self, hashes: np.ndarray, finals: np.ndarray) -> None:
        """Hold different chunks that are not held yet; the table stays at most half full."""
        self.chunks += len(hashes)
        if 2 * self.chunks > len(self.keys):
            held = np.flatnonzero(self.finals >= 0)
            hashes, finals = np.concatenate([self.keys[held], hashes]), np.concatenate([self.finals[held], finals])
            size = 1 << (2 * self.chunks).bit_length()
            self.keys, self.finals = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        shift, last = np.uint64(64 - len(self.keys).bit_length() + 1), len(self.keys) - 1
        at = (hashes >> shift).astype(np.int64)
        while len(at):
            free = np.flatnonzero(self.finals[at] < 0)
            self.finals[at[free]] = finals[free]  # of several for a place the last stays
            won = self.finals[at] == finals
            self.keys[at[won]] = hashes[won]
            hashes, finals, at = hashes[~won], finals[~won], (at[~won] + 1) & last

    def find(self, hashes: np.ndarray, code: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The last nodes of the chunks ``code[first:first + size]``; those not held are built."""
        out = self.look_up(hashes)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new, at, kind = np.unique(hashes[missing], return_index=True, return_inverse=True)
            at = missing[at]
            finals = self._build(code[ragged(first[at], size[at])], size[at])
            self._enter(new, finals)
            out[missing] = finals[kind]
        return out

    def _build(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        lattices = Lattices(self.vocabulary, flat, size)
        roots, edges = int(lattices.many[0]), lattices.edges[1:]
        chunk = np.repeat(np.arange(roots), lattices.lengths)
        end = np.arange(1, len(chunk) + 1) - np.repeat(np.cumsum(lattices.lengths) - lattices.lengths, lattices.lengths)
        node = lattices.base[end] + chunk
        counts = np.concatenate([np.diff(e[3]) for e in edges])
        first, counts = (np.cumsum(counts) - counts)[node - roots], counts[node - roots]
        order = ragged(first, counts)
        origin, piece, share = (np.concatenate([e[i] for e in edges])[order] for i in range(3))
        begin = np.cumsum(counts) - counts
        number = np.full(len(lattices.alpha), -1)
        number[node] = begin + self.edges
        # sums of a node's shares, edge by edge, so that they are the same whatever else is built
        upto = share.copy()
        more, j = begin[counts > 1], 1
        sizes = counts[counts > 1]
        while len(more):
            upto[more + j] += upto[more + j - 1]
            j += 1
            more, sizes = more[sizes > j], sizes[sizes > j]
        upto[begin + counts - 1] = np.inf
        n = len(self.vocabulary.pieces)
        if lattices.unknown:
            known = np.array([self.spelled.setdefault(tuple(x), len(self.spelled)) for x in lattices.unknown])
            far = np.flatnonzero(piece >= n)
            piece[far] = n + known[piece[far] - n]
            fresh = list(self.spelled)[len(self.spelling) :]
            table = np.array([x + (0,) * (4 - len(x)) for x in fresh], np.int32).reshape(-1, 4)
            self.spelling = np.concatenate([self.spelling, table])
            self.spelling_size = np.concatenate([self.spelling_size, np.array([len(x) for x in fresh], np.int64)])
        self.first_edge = _put(self.first_edge, self.nodes, np.append(begin, len(share)) + self.edges)
        self.origin = _put(self.origin, self.edges, number[origin])
        self.piece, self.share, self.upto = _put(self.piece, self.edges, piece), _put(self.share, self.edges, share), _put(self.upto, self.edges, upto)
        finals = np.empty(len(size), np.int32)
        finals[lattices.order] = number[lattices.final]
        self.nodes += len(node)
        self.edges += len(share)
        return finals


def _put(held: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """``held`` with ``values`` from ``at`` on, in a larger array if they don't fit."""
    if at + len(values) > len(held):
        held, old = np.empty(max(at + len(values), 2 * len(held)), held.dtype), held
        held[:at] = old[:at]
    held[at : at + len(values)] = values
    return held


class Chunks:
    """Occurrences of chunks in texts, and the lattices of the distinct ones, which ``shelf`` holds."""

    def __init__(self, shelf: Shelf, texts: list[str]):
        joined = "".join(" " + t for t in texts if t)
        code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        edge = np.concatenate([[0], np.cumsum(lengths)])
        space = code == 32
        code = np.where(code == ord(MARKER), np.uint32(OWN_MARKER), code)
        code[space] = ord(MARKER)
        alone = shelf.alphabet[np.minimum(code, len(shelf.alphabet) - 1)] == 0
        begin = np.ones(len(code), bool)
        if len(code):
            begin[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
            begin[edge[:-1][lengths > 0]] = True
        first = np.flatnonzero(begin)
        size = np.diff(np.append(first, len(code)))
        hashes = B.run_hashes(B.mix(code.astype(np.uint64) + np.uint64(1)), first, first + size)
        if shelf.edges >= shelf.limit:
            shelf.clear()
        self.final = shelf.find(hashes, code, first, size)
        self.text_first = np.searchsorted(first, edge)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.text_first))
        self.place = np.arange(len(first)) - self.text_first[self.text] if len(first) else np.zeros(0, np.int64)
        self.first_edge, self.origin, self.piece, self.share, self.upto = shelf.first_edge[: shelf.nodes + 1], shelf.origin, shelf.piece, shelf.share, shelf.upto
        self.spelling, self.spelling_size = shelf.spelling, shelf.spelling_size


def _walk(c: Chunks, node: np.ndarray, seed: np.ndarray, turn: int, chunk: tuple[np.ndarray, np.ndarray], skip: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Sample the edges from each node back to its chunk's root: their numbers, and (cursor, edge, share, piece) step by step.

    ``chunk``: the text of each cursor, and the place of its chunk there.  Cursors go in order of their nodes, so what the shelf
    holds is read from one end to the other.
    """
    counts, steps = np.zeros(len(node), np.int64), []
    own = B.mix(stream(seed, turn)[chunk[0]] + chunk[1].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    live = np.argsort(node)
    live = live[np.count_nonzero(node < 0) :]
    node, own, skip = node[live], own[live], skip[live]
    k = 0
    while len(live):
        u = uniform(own, skip + k)
        edge = node.copy()
        many = np.flatnonzero(u > c.upto[edge])
        while len(many):
            edge[many] += 1
            many = many[u[many] > c.upto[edge[many]]]
        steps.append((live, edge, c.share[edge], c.piece[edge]))
        node = c.origin[edge]
        k += 1
        counts[live[np.flatnonzero(node < 0)]] = k
        go = np.flatnonzero(node >= 0)
        live, node, own, skip = live[go], node[go], own[go], skip[go]
    return counts, steps


def _fill(path: tuple[np.ndarray, ...], first: np.ndarray, steps: list[tuple[np.ndarray, ...]]) -> None:
    """Write the steps of a walk to ``path``, from where each cursor's begin."""
    for step, (cursor, *values) in enumerate(steps):
        at = first[cursor] + step
        for column, value in zip(path, values, strict=True):
            column[at] = value


def _path(n: int) -> tuple[np.ndarray, ...]:
    return np.empty(n, np.int32), np.empty(n), np.empty(n, np.int32)


class _Sample:
    """Edges of one segmentation of every text that has it, chunk by chunk, with their shares and pieces (``path``); where it branched off; what that lattice node excludes."""

    def __init__(self, path, first, value, start, barred):
        self.path, self.first, self.value, self.start, self.barred = path, first, value, start, barred
        self.edges, self.share, self.piece = path
        self.bounds = self.log_prob = self.gumbel = None

    def split(self, c: Chunks, turn: int, seed: np.ndarray) -> None:
        """Gumbel maxima of the parts that leave this segmentation at each of its decisions."""
        self.bounds = self.first[c.text_first]
        counts = np.diff(self.bounds)
        text = np.repeat(np.arange(len(counts)), counts)
        share = self.share
        run = np.concatenate([[0.0], np.cumsum(np.log(np.maximum(share, 1e-300)))])
        self.log_prob = run[self.bounds[1:]] - run[self.bounds[:-1]]
        # what lies before the decision at which a text branched off is another part's
        place = np.arange(len(text)) - self.bounds[text]
        own = np.flatnonzero(place >= self.start[text])
        text, place = text[own], place[own]
        # nothing is left where the node has no other edge; a share that is rounded to 1 leaves nothing either
        left = 1.0 - share[own]
        at = np.flatnonzero((self.start >= 0) & (self.start < counts))
        branch = np.searchsorted(own, self.bounds[at] + self.start[at])
        for column in range(self.barred.shape[1]):
            some = self.barred[at, column] >= 0
            left[branch[some]] -= c.share[self.barred[at[some], column]]
        some = np.flatnonzero(left > 1e-15)
        text, place, own = text[some], place[some], own[some]
        with np.errstate(over="ignore"):
            mass = run[own] - run[self.bounds[text]] + np.log(left[some])
            noise = -np.log(uniform(stream(seed, turn, 1)[text], place))
            self.gumbel = np.full(len(share), -np.inf)
            self.gumbel[own] = mass - np.log(np.exp(mass - self.value[text]) + noise)

    def best(self) -> np.ndarray:
        """The highest maximum of each text, -inf where there is no part."""
        if not len(self.gumbel):
            return np.full(len(self.bounds) - 1, -np.inf)
        top = np.maximum.reduceat(np.append(self.gumbel, -np.inf), np.minimum(self.bounds[:-1], len(self.gumbel)))
        return np.where(np.diff(self.bounds) > 0, top, -np.inf)


def top_k(c: Chunks, keys: np.ndarray, k: int) -> tuple[list[_Sample], list[np.ndarray], np.ndarray]:
    """The samples by rank, which texts have each, and the value below the last of each text."""
    texts = len(c.text_first) - 1
    seed = B.mix(keys + np.uint64(0x51ED270B))
    chunks = len(c.text)
    counts, steps = _walk(c, c.final, seed, 0, (c.text, c.place), np.zeros(chunks, np.int64))
    first = np.concatenate([[0], np.cumsum(counts)])
    path = _path(first[-1])
    _fill(path, first, steps)
    value = -np.log(-np.log(uniform(stream(seed, 0, 2), 0)))
    samples = [_Sample(path, first, value, np.full(texts, -1), np.full((texts, k), -1))]
    have = [np.ones(texts, bool)]
    samples[0].split(c, 0, seed)
    for turn in range(1, k + 1):
        bests = np.stack([s.best() for s in samples])
        source = bests.argmax(axis=0)
        value = bests[source, np.arange(texts)]
        if turn == k:
            break
        active = np.isfinite(value)
        have.append(active)
        samples.append(_branch(c, samples, source, value, active, turn, seed, k))
    return samples, have, value


def _branch(c: Chunks, samples: list[_Sample], source: np.ndarray, value: np.ndarray, active: np.ndarray, turn: int, seed: np.ndarray, k: int) -> _Sample:
    """Take each active text's best part: its perturbed best segmentation."""
    texts = len(active)
    at, barred = np.full(texts, -1), np.full((texts, k), -1)
    branch_chunk, before, edge = np.full(texts, -1), np.zeros(texts, np.int64), np.full(texts, -1)
    for s, sample in enumerate(samples):
        mine = np.flatnonzero(active & (source == s))
        if not len(mine):
            continue
        where = np.flatnonzero(sample.gumbel == np.repeat(np.where(active & (source == s), value, np.nan), np.diff(sample.bounds)))
        owner = np.searchsorted(sample.bounds, where, "right") - 1
        owner, one = np.unique(owner, return_index=True)
        where = where[one]
        sample.gumbel[where] = -np.inf
        at[owner] = where - sample.bounds[owner]
        old = sample.edges[where]
        same = at[owner] == sample.start[owner]
        barred[owner] = np.where(same[:, None], sample.barred[owner], -1)
        barred[owner, turn - 1] = old
        branch_chunk[owner] = np.searchsorted(sample.first, where, "right") - 1
        before[owner] = where - sample.first[branch_chunk[owner]]
        # another edge into the same lattice node, by their shares
        node = np.searchsorted(c.first_edge, old, "right") - 1
        many = c.first_edge[node + 1] - c.first_edge[node]
        option = ragged(c.first_edge[node], many)
        row = np.repeat(np.arange(len(owner)), many)
        weight = c.share[option] * ~(barred[owner][row] == option[:, None]).any(axis=1)
        run = np.cumsum(weight)
        base = np.concatenate([[0.0], run])[np.cumsum(many) - many]
        total = np.add.reduceat(weight, np.cumsum(many) - many)
        u = uniform(stream(seed, turn, 3)[owner], at[owner]) * total
        hit = (run - base[row] >= u[row]) & (weight > 0)
        last = np.flatnonzero(weight > 0)
        rows, one = np.unique(row[np.flatnonzero(hit)], return_index=True)
        pick = np.full(len(owner), -1)
        pick[row[last]] = option[last]  # the last with a share, if rounding left u above the sum
        pick[rows] = option[np.flatnonzero(hit)[one]]
        edge[owner] = pick
    chunk = np.arange(len(c.text))
    fresh = np.flatnonzero(active[c.text] & (chunk >= branch_chunk[c.text]))
    is_branch = chunk[fresh] == branch_chunk[c.text[fresh]]
    node = np.where(is_branch, c.origin[np.maximum(edge[c.text[fresh]], 0)], c.final[fresh])
    skip = np.where(is_branch, before[c.text[fresh]] + 1, 0)
    more, steps = _walk(c, node, seed, turn, (c.text[fresh], c.place[fresh]), skip)
    counts = np.zeros(len(chunk), np.int64)
    counts[fresh] = more + skip
    for s, sample in enumerate(samples):
        old = np.flatnonzero((active & (source == s))[c.text] & (chunk < branch_chunk[c.text]))
        counts[old] = np.diff(sample.first)[old]
    first = np.concatenate([[0], np.cumsum(counts)])
    path = _path(first[-1])
    _fill(path, first[fresh] + skip, steps)
    for s, sample in enumerate(samples):
        mine = np.flatnonzero(active & (source == s))
        b = branch_chunk[mine]
        # a text's chunks before the branch, and the edges before it there, lie together
        begin, size = c.text_first[mine], first[b] + before[mine] - first[c.text_first[mine]]
        to, from_ = ragged(first[begin], size), ragged(sample.first[begin], size)
        for column, old in zip(path, sample.path, strict=True):
            column[to] = old[from_]
        for column, of_edge in zip(path, (edge[mine], c.share[edge[mine]], c.piece[edge[mine]]), strict=True):
            column[first[b] + before[mine]] = of_edge
    out = _Sample(path, first, np.where(active, value, 0.0), np.where(active, at, 0), barred)
    out.split(c, turn, seed)
    return out


def piece_ids(c: Chunks, sample: _Sample, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of a sample's texts in reading order, and where each text's begin."""
    counts = np.diff(sample.first)
    back = np.repeat(sample.first[:-1] + sample.first[1:] - 1, counts) - np.arange(len(sample.edges))
    piece = sample.piece[back]
    n = len(vocabulary.pieces)
    far = np.flatnonzero(piece >= n)
    if not len(far):
        return piece, sample.bounds
    size = np.ones(len(piece), np.int64)
    size[far] = c.spelling_size[piece[far] - n]
    begin = np.concatenate([[0], np.cumsum(size)])
    ids = np.empty(begin[-1], np.int32)
    ids[begin[:-1]] = piece
    for j in range(4):
        some = far[size[far] > j]
        ids[begin[some] + j] = c.spelling[piece[some] - n, j]
    return ids, begin[sample.bounds]


def alphabet(vocabulary: Vocabulary) -> np.ndarray:
    """1 for each code point that some piece holds; the last entry stands for all beyond."""
    out = np.zeros(0x110001, np.uint8)
    spelled = {*vocabulary.bytes.tolist(), vocabulary.end}
    plain = [p for i, p in enumerate(vocabulary.pieces) if np.isfinite(vocabulary.logp[i]) and i not in spelled]
    out[np.unique(np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32))] = 1
    return out


def encode_texts(vocabulary: Vocabulary, letters: np.ndarray, texts: list[str], keys: np.ndarray, k: int, shelf: Shelf | None = None) -> list[dict]:
    """For each rank: which texts have it, their ids and offsets, log probabilities, perturbed values and inclusion."""
    c = Chunks(Shelf(vocabulary, letters) if shelf is None else shelf, texts)
    samples, have, below = top_k(c, keys, k)
    out = []
    for sample, mine in zip(samples, have, strict=True):
        ids, offsets = piece_ids(c, sample, vocabulary)
        with np.errstate(over="ignore"):
            inclusion = np.where(np.isfinite(below), -np.expm1(-np.exp(sample.log_prob - below)), 1.0)
        out.append({"have": mine, "ids": ids, "offsets": offsets, "log_prob": sample.log_prob, "perturbed": sample.value, "inclusion": inclusion})
    return out


def encode(docs: DataFrame, path: str = VOCABULARY, k: int = TOP_K, digests: bool = False, copies: bool = False) -> DataFrame:
    """``doc_id, rank, ids, log_prob, perturbed, inclusion``: up to ``k`` rows for each row of ``docs``, rank 0 first.

    With ``digests`` every sample is decoded where it is made, and ``decoded_sha256`` is the digest of that text.  With ``copies``
    equal rows, as a mix writes them, have samples of their own: the key of a row is its ``doc_id`` and its number among the rows of
    that id and text.  Such rows are alike, so whichever has a number, the result is the same for any partitioning.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        letters, decoder = alphabet(v), Decoder(v)
        shelf = Shelf(v, letters)
        for batch in batches:
            keys = batch["doc_id"].fill_null(-(1 << 62)).to_numpy().astype(np.int64).view(np.uint64)
            if copies:
                place = batch["copy"].to_numpy()
                keys = np.where(place > 0, stream(keys, 1) + place.astype(np.uint64), keys)
            for lo, hi, _, _ in B.pieces(batch["text"], PIECE_BYTES):
                texts = [t or "" for t in batch["text"].slice(lo, hi - lo).to_pylist()]
                ids = batch["doc_id"].slice(lo, hi - lo)
                for rank, x in enumerate(encode_texts(v, letters, texts, keys[lo:hi], k, shelf)):
                    mine = pa.array(x["have"])
                    lists = pa.ListArray.from_arrays(pa.array(x["offsets"].astype(np.int32)), pa.array(x["ids"]))
                    columns = {"doc_id": ids, "rank": pa.array(np.full(hi - lo, rank, np.int32)), "ids": lists} | {c: pa.array(x[c]) for c in ("log_prob", "perturbed", "inclusion")}
                    if digests:
                        data, at = decoder(x["ids"], x["offsets"])
                        columns["decoded_sha256"] = pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)])
                    whole = pa.record_batch(list(columns.values()), names=list(columns))
                    yield whole if x["have"].all() else whole.filter(mine)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if copies:
        same = Window.partitionBy("doc_id", "digest").orderBy("doc_id")
        rows = rows.withColumn("digest", F.xxhash64("text")).withColumn("copy", F.row_number().over(same).cast("long") - 1).drop("digest")
    return rows.mapInArrow(run, SAMPLES + (", decoded_sha256 string" if digests else ""))


class Decoder:
    """Bytes of each piece, one after another."""

    def __init__(self, vocabulary: Vocabulary):
        parts = []
        spelled = {int(i): bytes([b]) for b, i in enumerate(vocabulary.bytes)}
        for i, piece in enumerate(vocabulary.pieces):
            parts.append(spelled[i] if i in spelled else piece.replace(MARKER, " ").encode() if np.isfinite(vocabulary.logp[i]) and i != vocabulary.end else b"")
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def __call__(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of texts and their offsets; the space that stands in front of every text goes."""
        size, start = self.size[ids], self.start[ids]
        front = offsets[:-1][np.diff(offsets) > 0]
        front = front[(size[front] > 0) & (self.data[np.minimum(start[front], len(self.data) - 1)] == 32)]
        size[front] -= 1
        start[front] += 1
        return self.data[ragged(start, size)], np.concatenate([[0], np.cumsum(size)])[offsets]


def decode(samples: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``samples`` with their ``text``, decoded from ``ids``; other columns stay, an older ``text`` goes."""
    vocabulary = samples.sparkSession.sparkContext.broadcast(Vocabulary(path))
    columns = [c for c in samples.columns if c != "text"]
    schema = samples.select(*columns).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part["ids"]
                offsets = lists.offsets.to_numpy().astype(np.int64)
                flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                data, at = decoder(flat, offsets - offsets[0])
                text = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary()).cast(pa.string())
                yield pa.record_batch([*(part[c] for c in columns), text], names=[*columns, "text"])

    return samples.select(*columns).mapInArrow(run, schema)
