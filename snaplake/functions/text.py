"""Text columns: markup to text, boilerplate, numbers, aliases, and known terms in phrases and free text."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_KEPT_CHARS = 400
EDGE = " .,;:()"


#: From an ``&`` to the next character that no entity can have: entities, and what they make together, lie within.
ENTITIES = r"&[^\t\n\f <]*"


def _lists_decoded(lists: pa.Array) -> pa.Array:
    """Lists, or lists of lists, with their strings decoded twice; equal ones once."""
    flat = lists.flatten()
    if pa.types.is_list(flat.type):
        inner = _lists_decoded(flat)
    else:
        coded = flat.dictionary_encode()
        inner = pa.array([x and html.unescape(html.unescape(x)) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    sizes = pc.fill_null(lists.value_lengths(), 0).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes)])
    return pa.ListArray.from_arrays(offsets, inner, mask=lists.is_null())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _decoded(lists: pa.Array) -> pa.Array:
    return _lists_decoded(lists)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _all_decoded(lists: pa.Array) -> pa.Array:
    return _lists_decoded(lists)


def _entities(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({ENTITIES})"), F.lit(1))


def _put(c: Column, decoded: Column) -> Column:
    """A text with what :func:`_entities` found in it replaced."""
    return F.array_join(F.zip_with(F.split(c, ENTITIES, -1), decoded, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def html_to_text(column: str | Column) -> Column:
    """Plain text of (perhaps escaped) HTML: entities decoded twice, block ends as line ends, items as "- ", no tags, blanks squeezed.

    Only runs with an ``&`` leave the JVM, in Arrow batches; the texts stay.
    """
    c = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
    return _without_tags(F.when(F.contains(c, F.lit("&")), _put(c, _decoded(_entities(c)))).otherwise(c))


def html_to_texts(column: Column) -> Column:
    """:func:`html_to_text` of each string of an array."""
    c = F.transform(column, lambda x: F.coalesce(x, F.lit("")))
    decoded = F.zip_with(c, _all_decoded(F.transform(c, _entities)), _put)
    return F.transform(F.when(F.exists(c, lambda x: F.contains(x, F.lit("&"))), decoded).otherwise(c), _without_tags)


def _without_tags(c: Column) -> Column:
    steps = [(r"(?i)<\s*(br|/p|/li|/h[0-9])\s*/?>", "\n"), (r"(?i)<li[^>]*>", "- "), (r"<[^>]+>", " "), (r"[ \t]+", " "), (r"\n(?U:\s)*\n+", "\n")]
    return F.regexp_replace(reduce(lambda x, s: F.regexp_replace(x, *s), steps, c), r"(?U)^\s+|\s+$", "")


def without_boilerplate(column: str | Column, markers: Sequence[str | Column], least: int = MIN_KEPT_CHARS) -> Column:
    """Cut at the earliest marker (not one at the very start) if at least ``least`` characters stay."""
    c = F.col(column) if isinstance(column, str) else column
    places = [F.nullif(F.greatest(F.instr(c, m) if isinstance(m, str) else F.position(m, c), F.lit(1)), F.lit(1)) for m in markers]
    cut = (F.least(*places) if len(places) > 1 else places[0]) - 1
    return F.when(cut >= least, F.btrim(F.left(c, cut.cast("int")))).otherwise(F.btrim(c))


def numbers(column: str | Column) -> Column:
    """The distinct numbers in a text, in order."""
    return F.array_distinct(F.regexp_extract_all(column, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)))


def tidy(column: str | Column) -> Column:
    """Lowered, blanks squeezed, no punctuation at the ends."""
    return F.btrim(F.regexp_replace(F.btrim(F.lower(column)), r"\s+", " "), F.lit(EDGE))


def with_alias(column: str | Column, aliases: Mapping[str, str]) -> Column:
    """The canonical name of a tidy term, or the term."""
    c = tidy(column)
    if not aliases:
        return c
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), c), c)


def squeezed(column: str | Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(column), r"(?U)\s+", " "))


def pieces(column: str | Column) -> Column:
    """A lowered text, blanks squeezed, as words of ``a-z0-9`` and what stands between them, in turn."""
    return F.regexp_extract_all(squeezed(column), F.lit("[a-z0-9]+|[^a-z0-9]+"), F.lit(0))


def vocabulary_table(spark: SparkSession, spellings: Mapping[str, str]) -> DataFrame:
    """``term, name`` of each spelling: lower-case, blanks squeezed, starting and ending with a letter or digit.

    An Arrow table becomes a relation whose size Spark knows, so that it broadcasts a small vocabulary and shuffles a large one.
    """
    for s in spellings:
        parts = re.findall("[a-z0-9]+|[^a-z0-9]+", s)
        if s != " ".join(s.lower().split()) or len(parts) % 2 == 0 or not parts[0].isalnum():
            raise ValueError(f"a spelling is lower-case and starts and ends with a letter or digit: {s!r}")
    return spark.createDataFrame(pa.table({"term": pa.array(list(spellings), pa.string()), "name": pa.array(list(spellings.values()), pa.string())}))


def vocabulary_of(spark: SparkSession, terms: Mapping[str, str] | DataFrame) -> tuple[DataFrame, list[int]]:
    """The table of a vocabulary, and the numbers of :func:`pieces` that its spellings have (as many values as the longest spelling has words)."""
    known = terms if isinstance(terms, DataFrame) else vocabulary_table(spark, terms)
    if not isinstance(terms, DataFrame):
        return known, sorted({len(re.findall("[a-z0-9]+|[^a-z0-9]+", s)) for s in terms})
    return known.select("term", "name"), sorted(r["n"] for r in known.select(F.size(pieces("term")).alias("n")).distinct().collect())


def _spans(cut: Column, sizes: Sequence[int]) -> Column:
    """``array<struct<at, size, term>>``: every run of ``sizes`` pieces that starts and ends with a word."""
    first = F.when(F.get(cut, 0).rlike("^[a-z0-9]"), 1).otherwise(2)  # words and what is between them take turns
    none = F.array().cast("array<struct<at: int, size: int, term: string>>")

    def of(n: int) -> Column:
        last = F.size(cut) - (n - 1)
        term = (lambda i: F.element_at(cut, i)) if n == 1 else (lambda i: F.array_join(F.slice(cut, i, n), ""))
        return F.when(last >= first, F.transform(F.sequence(first, last, F.lit(2)), lambda i: F.struct(i.alias("at"), F.lit(n).alias("size"), term(i).alias("term")))).otherwise(none)

    return F.concat(none, *[of(n) for n in sizes])


def _with_pieces(column: str | Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a text's pieces.  They are a lambda's argument, so the text is cut once however often, and wherever, they are used."""
    return F.get(F.transform(F.array(pieces(column)), use), 0)


def grams(column: str | Column, sizes: Sequence[int], lowered: Callable[[str | Column], Column] = squeezed) -> Column:
    """The distinct runs of words of a ``lowered`` text in the given numbers of pieces: a pattern for each number looks ahead from every word's start."""
    runs = []
    for n in sizes:
        run = r"[a-z0-9]++" + r"[^a-z0-9]++[a-z0-9]++" * (n // 2)
        runs.append(F.regexp_extract_all(lowered(column), F.lit(run if n == 1 else f"(?<![a-z0-9])(?=({run}))"), F.lit(int(n > 1))))
    return F.array_distinct(F.concat(*runs)) if runs else F.array().cast("array<string>")


def likely_runs(low: str, known: DataFrame) -> Column:
    """Those :func:`grams` of a lowered text that start as a spelling of ``known`` does and have as many pieces: few, to be joined to the spellings.

    The first words of the spellings go to the tasks, as a model would.
    """
    starts: dict[str, list[int]] = {}
    for r in known.select(pieces("term").alias("p")).select(F.get("p", 0).alias("first"), F.size("p").alias("n")).distinct().collect():
        starts.setdefault(r["first"], []).append(r["n"])
    cut, words = re.compile("[a-z0-9]+|[^a-z0-9]+").findall, re.compile("[a-z0-9]+").findall

    def runs(text: str) -> list[str]:
        if starts.keys().isdisjoint(words(text)):
            return []
        p = cut(text)
        return list({"".join(p[i : i + n]) for i in range(not "a" <= p[0][0] <= "z" and not "0" <= p[0][0] <= "9", len(p), 2) if p[i] in starts for n in starts[p[i]] if i + n <= len(p)})

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def of(texts: pa.Array) -> pa.Array:
        return pa.array((None if t.as_py() is None else runs(t.as_py()) for t in texts), pa.list_(pa.string()))

    return of(low)


def canonical_terms(phrases: DataFrame, column: str, vocabulary: Sequence[str] | DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """``phrases`` with ``terms``: the known names in each phrase, or the cleaned phrase if there is none.

    ``vocabulary`` is a table of ``term, name``, or names with ``aliases`` for them.  A phrase that is a name or an alias stands for that alone.  Else of the
    spellings in it the longest is taken first (equal lengths by the alphabet), then every other that does not overlap a taken one; names come in reading
    order, each once.  Works on the distinct phrases, whose runs of words meet the vocabulary in a join, and which are joined back.
    """
    spark = phrases.sparkSession
    spelled = vocabulary if isinstance(vocabulary, DataFrame) else {n: n for n in {*vocabulary, *(aliases or {}).values()}} | dict(aliases or {})
    known, sizes = vocabulary_of(spark, spelled)
    low = squeezed("phrase")
    rows = phrases.select(F.col(column).alias("phrase")).where(F.col("phrase").isNotNull()).distinct()
    found = rows.select("phrase", F.explode(_with_pieces("phrase", lambda cut: _spans(cut, sizes))).alias("s")).select("phrase", "s.*").join(known, "term")
    ranked = found.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct((-F.length("term")).alias("least"), "term", "at", "size", "name"))).alias("ranked"))
    none = F.array().cast("array<struct<at: int, size: int, name: string>>")
    apart = lambda a, b: (a["at"] + a["size"] <= b["at"]) | (b["at"] + b["size"] <= a["at"])
    as_taken = lambda s: F.struct(s["at"].alias("at"), s["size"].alias("size"), s["name"].alias("name"))
    taken = F.aggregate("ranked", none, lambda got, s: F.when(F.forall(got, lambda t: apart(t, s)), F.concat(got, F.array(as_taken(s)))).otherwise(got))
    names = ranked.select(F.col("phrase").alias("__p"), F.array_distinct(F.transform(F.sort_array(taken), lambda s: s["name"])).alias("names"))
    whole = known.select(F.col("term").alias("__whole"), F.col("name").alias("whole"))
    clean = known.select(F.col("term").alias("__clean"), F.col("name").alias("clean"))
    rows = rows.withColumns({"low": low, "tidy": tidy("phrase"), "cleaned": tidy(F.regexp_replace(low, r"\(.*?\)", " "))})
    rows = rows.join(names, F.col("phrase") == F.col("__p"), "left").join(whole, F.col("tidy") == F.col("__whole"), "left").join(clean, F.col("cleaned") == F.col("__clean"), "left")
    terms = (
        F.when(F.col("low") == "", F.array().cast("array<string>"))
        .when(F.col("whole").isNotNull(), F.array("whole"))
        .when(F.size("names") > 0, F.col("names"))
        .otherwise(F.filter(F.array(F.coalesce("clean", "cleaned")), lambda c: c != ""))
    )
    # dealt anew, so that Spark sees the size of what is joined back and broadcasts it if small: many rows may share a few phrases
    back = rows.select(F.col("phrase").alias("__phrase"), terms.alias("terms")).repartition(F.xxhash64("__phrase"))
    return phrases.join(back, F.col(column) == F.col("__phrase"), "left").drop("__phrase")


def mentions(texts: DataFrame, key: str, column: str, terms: Mapping[str, str] | DataFrame) -> DataFrame:
    """Distinct ``key, term`` of the known terms that a text mentions as whole words, longer spellings and those inside them alike.

    ``terms`` maps each spelling to its name, as a mapping or as a table of ``term, name``.  A text is cut into words once; its distinct runs that start as a spelling does
    are joined to the vocabulary by hash, so the work grows with the text, whatever the number of terms.  Spark broadcasts the vocabulary if it is small.
    """
    known, _ = vocabulary_of(texts.sparkSession, terms)
    runs = texts.select(key, squeezed(column).alias("__low")).select(key, likely_runs("__low", known).alias("__runs"))
    found = runs.select(key, F.explode("__runs").alias("term")).join(known, "term")
    return found.select(key, F.col("name").alias("term")).distinct()


def known_term(column: str, vocabulary: Sequence[str]) -> Column:
    return F.col(column).isin(list(vocabulary))


def inflated(headline: str, titles: str, ranks: Sequence[str]) -> Column:
    """Words of rank in a headline that no real title has."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: w != "")
    return F.array_except(F.array_intersect(words(headline), F.array(*map(F.lit, ranks))), words(titles))
