"""Subword lattices of many words at once, over the pieces of an existing SentencePiece vocabulary.

The text form is SentencePiece's: one marker in front, each space a marker.  Pieces hold a marker only at their start, so a text
splits exactly into chunks (markers, then other characters) that have lattices of their own.  A character without a
piece falls back to the pieces of its UTF-8 bytes; so does a marker that the text holds itself, which makes decoding exact.

The vocabulary's scores are merge ranks.  They become log probabilities of a unigram model as ``1 / (rank + OFFSET)``,
normalised over all pieces.
"""

from __future__ import annotations

import numpy as np

MARKER = "▁"
#: A code outside Unicode that stands for a marker which is part of the text.
OWN_MARKER = 0x110000
OFFSET = 10.0
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xBF58476D1CE4E5B9)


class Vocabulary:
    """Pieces, log probabilities, and a table of all pieces and their prefixes by hash.

    Read on the driver and sent to the tasks, a few MB whatever the corpus.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.end = model.eos_id()
        self.bytes = np.full(256, -1, np.int64)
        plain, rank = {}, np.full(n, np.inf)
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                rank[i] = n
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain[piece] = i
        for place, piece in enumerate(sorted(plain, key=lambda p: (-max(model.get_score(plain[p]), -float(n)), plain[p]))):
            rank[plain[piece]] = place
        rank[self.end] = 0
        weight = 1.0 / (rank + OFFSET)
        self.logp = np.where(weight > 0, np.log(np.maximum(weight, 1e-300) / weight.sum()), -np.inf)
        self.longest = max(map(len, plain))
        self._table(plain)

    def _table(self, plain: dict[str, int]) -> None:
        found = {p[:k]: -1 for p in plain for k in range(1, len(p))} | plain
        keys = np.array([self._hash(p) for p in found], np.uint64)
        self.bits = int(np.ceil(np.log2(len(found) * 6)))
        size = 1 << self.bits
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -2, np.int32)
        for key, value in zip(keys.tolist(), found.values(), strict=True):
            at = key >> (64 - self.bits)
            while self.values[at] != -2:
                at = (at + 1) & (size - 1)
            self.keys[at], self.values[at] = key, value

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(MULTIPLIER) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return int(_mix(np.array([h], np.uint64))[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each running hash, -1 for a mere prefix, -2 for neither."""
        key = _mix(h)
        at = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.values[at]
        open_ = np.flatnonzero((out != -2) & (self.keys[at] != key))
        at, key = at[open_], key[open_]
        while len(open_):
            at = (at + 1) & (len(self.keys) - 1)
            now = self.values[at]
            hit = (now == -2) | (self.keys[at] == key)
            out[open_[hit]] = now[hit]
            open_, at, key = open_[~hit], at[~hit], key[~hit]
        return out

    def byte_pieces(self, code: int) -> list[int]:
        """Pieces of the bytes of a character; a surrogate counts as the replacement character."""
        text = MARKER if code == OWN_MARKER else chr(code)
        return [int(self.bytes[b]) for b in text.encode("utf-8", "replace")]


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``words`` one after another, and their lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), lengths


class Lattices:
    """The lattices of ``words``, each ``codes`` of one chunk, by length from long to short.

    Nodes are numbered end by end, so all that ends after character ``e`` lies together: ``base[e] + word``.  ``edges[e]`` holds
    start node, piece and conditional probability of the edges into nodes of end ``e``, grouped by word.  Pieces
    from ``len(vocabulary)`` on are characters without a piece, listed in ``unknown``.
    """

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray, lengths: np.ndarray, logp: np.ndarray | None = None):
        v, n = vocabulary, len(lengths)
        self.vocabulary = v
        logp = v.logp if logp is None else logp
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        longest = int(self.lengths[0]) if n else 0
        many = n - np.searchsorted(self.lengths[::-1], np.arange(longest + 1), "left") if n else np.zeros(1, np.int64)  # words of at least e characters
        self.many, self.base = many, np.concatenate([[0], np.cumsum(many)])
        self.alpha = np.full(int(self.base[-1]), -np.inf)
        self.alpha[: many[0]] = 0.0
        self.unknown: list[list[int]] = []
        node, origin, piece, extra = self._edges(flat, lengths, logp)
        weights = np.concatenate([logp, extra]) if extra else logp
        first = np.searchsorted(node, np.arange(len(self.alpha) + 1))  # of each node's edges, which lie together
        self.edges = [None]
        for e in range(1, longest + 1):
            lo, hi = int(self.base[e]), int(self.base[e] + many[e])
            a, b = int(first[lo]), int(first[hi])
            groups = first[lo : hi + 1] - a
            from_, p, size = origin[a:b], piece[a:b], np.diff(groups)
            value = self.alpha[from_] + weights[p]
            top = np.maximum.reduceat(value, groups[:-1])
            part = np.exp(value - np.repeat(top, size))
            total = np.add.reduceat(part, groups[:-1])
            self.alpha[lo:hi] = top + np.log(total)
            self.edges.append((from_, p, part / np.repeat(total, size), groups))
        self.final = self.base[self.lengths] + np.arange(n)

    def _edges(self, flat: np.ndarray, lengths: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
        """End node, start node and piece of all edges by end node, from long pieces to short, and the weights of unknown characters.

        All places of all words look up their next one, two, ... characters together, as long as these begin some piece.
        """
        v, n = self.vocabulary, len(lengths)
        first = (np.cumsum(lengths) - lengths)[self.order]
        word = np.repeat(np.arange(n), self.lengths)
        place = np.arange(len(word)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        code = flat[first[word] + place].astype(np.uint64)
        left = self.lengths[word] - place
        at, h = np.arange(len(word)), np.zeros(len(word), np.uint64)
        ends, sizes, pieces, extra = [], [], [], []
        for size in range(1, v.longest + 1):
            h = h * MULTIPLIER + code[at + size - 1] + np.uint64(1)
            value = v.find(h)
            hit = np.flatnonzero(value >= 0)
            ends.append(at[hit])
            pieces.append(value[hit].astype(np.int64))
            sizes.append(np.full(len(hit), size))
            if size == 1 and len(hit) < len(at):
                own = np.flatnonzero(value < 0)
                letters, kind = np.unique(code[own], return_inverse=True)
                self.unknown = [v.byte_pieces(int(c)) for c in letters]
                extra = [float(logp[ids].sum()) for ids in self.unknown]
                ends.append(at[own])
                pieces.append(len(v.pieces) + kind)
                sizes.append(np.ones(len(own), np.int64))
            go = np.flatnonzero((value != -2) & (left[at] > size))
            at, h = at[go], h[go]
            if not len(at):
                break
        if not ends:
            z = np.zeros(0, np.int64)
            return z, z, z, extra
        at, size, piece = (np.concatenate(x) for x in (ends, sizes, pieces))
        node = self.base[place[at] + size] + word[at]
        order = np.argsort(node * (v.longest + 1) + (v.longest - size))
        origin = self.base[place[at]] + word[at]
        return node[order], origin[order], piece[order], extra

    def log_probabilities(self) -> np.ndarray:
        """Log of the summed weight of all segmentations of each word, in the order given."""
        out = np.empty(len(self.lengths))
        out[self.order] = self.alpha[self.final]
        return out

    def expected_counts(self, times: np.ndarray) -> np.ndarray:
        """How often each piece is expected when word i occurs ``times[i]`` times; bytes count for unknown characters."""
        v = self.vocabulary
        node = np.zeros(len(self.alpha))
        node[self.final] = times[self.order]
        flows = []
        for e in range(len(self.edges) - 1, 0, -1):
            from_, p, share, groups = self.edges[e]
            flow = share * np.repeat(node[self.base[e] : self.base[e] + self.many[e]], np.diff(groups))
            node[from_] += flow
            flows.append((p, flow))
        size = len(v.pieces) + len(self.unknown)
        counts = np.bincount(np.concatenate([p for p, _ in flows]), np.concatenate([f for _, f in flows]), size) if flows else np.zeros(size)
        for k, ids in enumerate(self.unknown):
            np.add.at(counts, ids, counts[len(v.pieces) + k])
        return counts[: len(v.pieces)]
