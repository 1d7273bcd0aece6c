"""Personal data: fixed patterns, and identifiers discovered from their contexts by bootstrapping.

The fixed patterns give seed entities.  Instances are named by their values: every other run of characters that holds ``@`` or 4
digits, and every group of such items with digits that single spaces part (``555 123 4567``), of any length.  The patterns of an
instance are the names around it (parts of words between signs, however far): the two before, and the one before with the one
after; at an end of the text, where one is missing, there is no such pattern.  Patterns and instances form a graph.  Each round
scores patterns by the share of their distinct instances that are trusted so far, smoothed so that rare patterns
earn little, and instances by their best pattern; instances over the threshold are trusted in the next round.

A second read of the texts counts how often any word at all stands in the place of each trusted pattern: one that common words
fill as well says nothing about identifiers.  Patterns whose trusted instances make up enough of these are specific.  A third read
finds what stands next to a specific pattern: instances, and every other word (few digits or none), of which words of plain
shape (letters or digits only) need both of their patterns, others one.  They are reported with the kind ``context``; a
group and an item in it may both be.

All counts are grouped by pattern and instance before they are joined, so a pattern that stands in a third of all
rows is one row of the graph.

Cases: null and empty texts have no findings; without seeds nothing is trusted and nothing is added; repeated rows get a row each
and count once in the graph, which holds distinct edges; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm import spans as S
from snaplake.llm.spans import Taken
from snaplake.storage import Scratch, stored

KINDS = ["email", "ip", "card", "phone", "context"]
# The patterns that define base findings.  Emails and addresses are matched piece by piece (``emails``, ``ips``), as
# a search by the whole pattern takes time in the square of a long run's length:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+     ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

EDGES = ".,;:!?()[]{}<>\"'`*#$%&|="
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What contexts are made of: parts of words between signs.
NAME = re.compile(r"[^\x20\x09-\x0D" + re.escape(EDGES) + "]+")
#: Rounds; confidence a pattern needs; distinct instances it needs; what is added to its count; score an instance needs to be trusted.
ROUNDS, MIN_CONFIDENCE, MIN_SUPPORT, SMOOTHING, MIN_TRUST = 3, 0.6, 5, 2.0, 0.6
DIGIT = re.compile("[0-9]")
#: What stands between two items of a group; shapes that any common word or number has; bits of the filter of patterns.
BETWEEN = re.compile(r"\x20(?:[A-Z]{1,4}\x20)?")
PLAIN = re.compile(r"[a'\u2019-]+|0")
#: A prime, by which pattern numbers are folded into the filter.
BITS = 4_194_301


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: at each ``@`` the run of local characters before it, from the last match on, and the domain after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        done = at + 1
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", done)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: in each run of numbers that dots join, four at a time; those with a part above 255 fail."""
    out = []
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the fixed patterns find.  A pattern is tried only where a character that it needs occurs."""
    found = []
    if "@" in text:
        found += [("email", *m) for m in emails(text)]
    if DIGIT.search(text):
        if "." in text:
            found += [("ip", *m) for m in ips(text)]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return S.ordered(found, KINDS)


def shape(value: str) -> str:
    """Letters as ``a``, digits as ``0``, runs shortened to their kind."""
    return re.sub(r"0+", "0", re.sub(r"a+", "a", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "0", value))))


class Names:
    """The names of a text in order, and the patterns around its spans: two names before; one before and one after."""

    def __init__(self, text: str):
        found = [(m.start(), m.end()) for m in NAME.finditer(text)]
        self.text, self.starts, self.ends = text, [a for a, _ in found], [b for _, b in found]

    def name(self, k: int) -> str:
        return self.text[self.starts[k] : self.ends[k]].lower()

    def patterns(self, start: int, end: int) -> list[str]:
        """Patterns of whole names outside the span; where a name is missing there is no pattern."""
        before, after = bisect_right(self.ends, start), bisect_left(self.starts, end)
        out = [f"{self.name(before - 2)} {self.name(before - 1)} _"] if before > 1 else []
        return out + ([f"{self.name(before - 1)} _ {self.name(after)}"] if before and after < len(self.starts) else [])


def instances(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds and other identifier-like items with their patterns."""
    if not ("@" in text or DIGIT.search(text)):
        return []
    items, taken = [], Taken(base)
    for m in WORD.finditer(text):
        word = m[0]
        if "@" in word or DIGIT.search(word):
            value = word.strip(EDGES)
            a = m.start() + len(word) - len(word.lstrip(EDGES))
            if value and taken.clear(a, a + len(value)):
                items.append((a, a + len(value)))
    found = [(a, b, False) for a, b in items if strong(text[a:b])] + [(a, b, False) for a, b in groups(text, items) if strong(text[a:b])]
    found += [(a, b, True) for _, a, b in base]
    if not found:
        return []
    names = Names(text)
    return [{"start": a, "end": b, "seed": seed, "value": text[a:b].lower(), "patterns": names.patterns(a, b)} for a, b, seed in found]


def strong(value: str) -> bool:
    """Whether a value may be an identifier by itself."""
    return "@" in value or len(DIGIT.findall(value)) >= 4


def groups(text: str, items: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of two and more items with digits between which only a space, or a short word in capitals, stands."""
    out, run = [], []
    for a, b in items:
        if "@" in text[a:b]:
            continue
        if run and BETWEEN.fullmatch(text, run[-1][1], a):
            run.append((a, b))
            continue
        if len(run) > 1:
            out.append((run[0][0], run[-1][1]))
        run = [(a, b)]
    if len(run) > 1:
        out.append((run[0][0], run[-1][1]))
    return out


def number(pattern: str) -> int:
    """A pattern as 63 bits from the CRCs of its two names, and a sign for its kind; :func:`pattern_number` in Spark."""
    one, two, three = pattern.split(" ")
    first, second = (zlib.crc32(w.encode()) for w in ((one, two) if three == "_" else (one, three)))
    h = (first % (1 << 31) << 32) + second
    return h if three == "_" else -h - 1


def pattern_number(pattern: str) -> F.Column:
    p = F.split(pattern, " ")
    crc = lambda w: F.crc32(F.encode(w, "UTF-8"))
    h = (crc(p[0]) % (1 << 31)) * F.lit(1 << 32) + crc(F.when(p[2] == "_", p[1]).otherwise(p[2]))
    return F.when(p[2] == "_", h).otherwise(-h - 1)


class Slots:
    """The numbers of the patterns that stand around every word of a text."""

    MOST = 1 << 18

    def __init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def _names(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.MOST:
                self.known.clear()
            found = self.known[word] = tuple(zlib.crc32(n.lower().encode()) for n in NAME.findall(word))
        return found

    def __call__(self, text: str) -> np.ndarray:
        parts = [p for p in map(self._names, WORD.findall(text)) if p]
        if len(parts) < 2:
            return np.zeros(0, np.int64)
        crc = np.fromiter(chain.from_iterable(parts), np.int64)
        first = np.cumsum([0, *map(len, parts)])[:-1]
        join = lambda a, b: (a % (1 << 31) << 32) + b
        two, one = first[first > 1], first[1:-1]
        return np.concatenate([join(crc[two - 2], crc[two - 1]), -join(crc[one - 1], crc[first[2:]]) - 1])


def weak_instances(text: str, taken: list[tuple[str, int, int]], holds: Callable[[str], bool]) -> list[dict]:
    """The words outside ``taken`` that stand next to a pattern which ``holds``."""
    out, names, taken_, k = [], Names(text), Taken(taken), 0
    for m in WORD.finditer(text):
        while k < len(names.starts) and names.starts[k] < m.start():
            k += 1  # the first name of this word
        if 0 < k < len(names.starts) and names.starts[k] < m.end():
            value = m[0].strip(EDGES)
            a = m.start() + len(m[0]) - len(m[0].lstrip(EDGES))
            b = a + len(value)
            if any(c.isalnum() for c in value) and not strong(value) and taken_.clear(a, b):
                patterns = [p for p in names.patterns(a, b) if holds(p)]
                if patterns:
                    out.append({"start": a, "end": b, "plain": PLAIN.fullmatch(shape(value)) is not None, "patterns": patterns})
    return out


FOUND = "array<struct<start: int, end: int, seed: boolean, value: string, patterns: array<string>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))
    for batch in batches:
        base, found = [], []
        for text in batch["text"]:
            text = text.as_py() or ""
            spans = base_spans(text)
            base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
            found.append(instances(text, spans))
        yield pa.record_batch([batch["doc_id"], pa.array(base, pa.list_(S.SPAN)), pa.array(found, kind)], names=["doc_id", "base", "found"])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, base spans and instances with their patterns, of each whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, f"doc_id long, base array<{S.SPAN_DDL}>, found {FOUND}")


def induce(found: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``pattern, confidence, support, trusted`` of the patterns that are trusted after ``rounds`` of scoring, and their ``times`` in the texts, with any and
    with trusted instances.

    ``found`` has rows of instances ``value, seed, patterns``.  A pattern's confidence is the sum of its trusted instances' scores
    over the number of its instances plus ``SMOOTHING``, if it has at least ``min_support`` of them; an instance's score is 1 for a seed, else its best pattern's confidence.
    """
    scratch = Scratch(found.sparkSession)
    edges = scratch.stored(found.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("times")), "pii-edges")
    seeds = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score"))
    scores, sure = seeds, F.col("score") >= MIN_TRUST
    for k in range(rounds):
        patterns = (
            edges.join(scores, "value")
            .groupBy("pattern")
            .agg(F.count("*").alias("support"), F.sum(F.when(sure, F.col("score")).otherwise(0.0)).alias("trusted"), F.sum("times").alias("times"), F.sum(F.when(sure, F.col("times")).otherwise(0)).alias("trusted_times"))
            .where((F.col("trusted") > 0) & (F.col("support") >= min_support))
            .select("pattern", "support", "trusted", "times", "trusted_times", (F.col("trusted") / (F.col("support") + SMOOTHING)).alias("confidence"))
        )
        if k + 1 == rounds:
            break
        patterns = scratch.stored(patterns, f"pii-patterns-{k}")
        best = edges.join(patterns, "pattern").groupBy("value").agg(F.max("confidence").alias("best"))
        scores = scratch.stored(seeds.join(best, "value", "left").select("value", F.greatest("score", F.coalesce("best", F.lit(0.0))).alias("score")), f"pii-scores-{k}")
    done = stored(patterns.where(F.col("confidence") >= min_confidence).select("pattern", "confidence", "support", "trusted", "times", "trusted_times"), "pii-trusted")
    scratch.drop()
    return done


FILLED = "array<struct<start: int, end: int, plain: boolean, patterns: array<string>>>"


def _bits(numbers: DataFrame) -> bytes:
    """A filter of the column ``h``: one bit for each number modulo ``BITS``, so its size does not grow with the numbers."""
    at = F.pmod("h", F.lit(BITS))
    found = numbers.select(F.shiftright(at, 5).alias("k"), F.expr(f"shiftleft(1L, CAST(pmod(h, {BITS}) % 32 AS INT))").alias("bit")).groupBy("k").agg(F.bit_or("bit").alias("bits")).collect()
    out = np.zeros(BITS // 32 + 1, "<u4")
    for r in found:
        out[r["k"]] = r["bits"]
    return out.tobytes()


def _member(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)


def _count(bits: bytes):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member, slots = _member(bits), Slots()
        for batch in batches:
            found = [h[member[h % BITS]] for text in batch["text"] if (h := slots(text.as_py() or "")).size]
            h, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            yield pa.record_batch([pa.array(h), pa.array(n)], names=["h", "n"])

    return count


def specific(docs: DataFrame, trusted: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The ``pattern`` rows of ``trusted`` whose place is filled by trusted instances often enough, of all words that stand there; written."""
    numbered = trusted.withColumn("h", pattern_number("pattern"))
    filled = docs.select("text").mapInArrow(_count(_bits(numbered)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    times = F.greatest("times", F.coalesce("n", F.lit(0)))
    return stored(numbered.join(filled, "h", "left").where(F.col("trusted_times") / (times + SMOOTHING) >= min_confidence).select("pattern", "h"), "pii-specific")


def _scan_filled(bits: bytes):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_()), ("patterns", pa.list_(pa.string()))]))
    some = any(bits)

    def scan_filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member, slots = _member(bits), Slots()
        holds = lambda p: bool(member[number(p) % BITS])
        for batch in batches:
            base, filled = [], []
            for text in batch["text"]:
                text = text.as_py() or ""
                spans = base_spans(text)
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
                out = []
                if some and text:
                    found = instances(text, spans)
                    out = [{"start": f["start"], "end": f["end"], "plain": False, "patterns": ps} for f in found if not f["seed"] and (ps := [p for p in f["patterns"] if holds(p)])]
                    if member[slots(text) % BITS].any():
                        out += weak_instances(text, spans + [("", f["start"], f["end"]) for f in found], holds)
                filled.append(out)
            yield pa.record_batch([batch["doc_id"], pa.array(base, pa.list_(S.SPAN)), pa.array(filled, kind)], names=["doc_id", "base", "filled"])

    return scan_filled


def find_personal_data(docs: DataFrame, **limits) -> DataFrame:
    """``doc_id, base, spans`` of each row: base spans, and all spans with those that specific patterns hold.

    The texts are read for the graph, for how its trusted patterns are filled, and for what stands next to specific patterns.  Rows
    of the last read are written and numbered.  Filters of fixed size tell where patterns stand; joins by pattern decide.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trusted = induce(scan(docs).select(F.explode("found").alias("f")).select("f.*"), **limits)
    sure = trusted.select("pattern", pattern_number("pattern").alias("h")) if trusted.isEmpty() else specific(texts, trusted, limits.get("min_confidence", MIN_CONFIDENCE))
    rows = texts.mapInArrow(_scan_filled(_bits(sure)), f"doc_id long, base array<{S.SPAN_DDL}>, filled {FILLED}")
    scanned = stored(rows.withColumn("row_id", F.monotonically_increasing_id()), "pii-scan")
    filled = scanned.select("row_id", F.explode("filled").alias("f")).select("row_id", "f.start", "f.end", "f.plain", F.explode("f.patterns").alias("pattern"))
    held = filled.join(sure.select("pattern"), "pattern").groupBy("row_id", "start", "end", "plain").agg(F.count("*").alias("n")).where(~F.col("plain") | (F.col("n") > 1))
    added = held.groupBy("row_id").agg(F.collect_set(F.struct(F.lit("context").alias("kind"), "start", "end")).alias("added"))
    every = F.concat("base", F.coalesce("added", F.expr(f"CAST(array() AS array<{S.SPAN_DDL}>)")))
    keyed = F.transform(F.array_sort(F.transform(every, lambda x: F.struct(x["start"].alias("start"), _rank(x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return scanned.join(added, "row_id", "left").select("doc_id", "base", keyed.alias("spans"))


def _rank(kind: F.Column) -> F.Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)
