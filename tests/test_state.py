"""State that follows new rows alone, sets of results under one pointer, counts that a write makes, and vocabularies as tables."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from snaplake.functions import text as t
from snaplake.operators import lifecycle as lc
from snaplake.operators import upsert, validate
from snaplake.storage import new_path
from snaplake.streaming import state

DDL = "job_key string, source string, company string, title string, location string, url string, raw_text string, posted_at string, snapshot_day date, loaded_at int, seq int, fetch_mode string"


@pytest.fixture(scope="module")
def days(spark):
    """Four days of rows: a posting that comes and goes, one with texts on some days, a manual one, nulls."""
    rows, seq = [], itertools.count()
    for day in (1, 2, 4, 9):
        for key, source, mode in (("a", "lever", "full"), ("b", "workday", "seen" if day > 2 else None), ("m", "manual", "full"), ("n", "lever", "seen")):
            if key == "a" and day == 4 or key == "m" and day > 1:
                continue
            text = None if mode == "seen" else "t" * (200 + day)
            rows.append((key, source, "c", f"{key}{day}" if day != 9 else None, "Pune", "https://x", text, f"2026-01-0{day}T00:00", dt.date(2026, 1, day), 10 - day, next(seq), mode))
    return spark.createDataFrame(rows, DDL)


def shown(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("order", [(1, 2, 4, 9), (9, 4, 2, 1), (4, 1, 9, 2)])
def test_state_is_the_same_whatever_the_order(spark, days, order):
    root = new_path(spark, "state")
    for batch, day in enumerate(order):
        rows = days.where(F.day("snapshot_day") == day)
        assert state.apply_batch(rows, batch, root) and not state.apply_batch(rows, batch, root) and not state.apply_batch(rows, 0, root)
    got = lc.from_summary(upsert.published(spark, root))
    assert shown(got) == shown(lc.postings(days).select(*got.columns))


def test_a_batch_that_failed_before_its_pointer_is_applied_later(spark, days, monkeypatch):
    root = new_path(spark, "state")
    state.apply_batch(days.where("snapshot_day < '2026-01-03'"), 0, root)
    with monkeypatch.context() as m:
        m.setattr(upsert, "_point", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            state.apply_batch(days.where("snapshot_day > '2026-01-03'"), 1, root)
    assert upsert.published(spark, root).agg(F.max("last_seen")).first()[0] == dt.date(2026, 1, 2)
    assert state.apply_batch(days.where("snapshot_day > '2026-01-03'"), 1, root)
    got = lc.from_summary(upsert.published(spark, root))
    assert shown(got) == shown(lc.postings(days).select(*got.columns))


def test_one_shuffle_by_key(days):
    plan = days.sparkSession._jvm.PythonSQLUtils.explainString(lc.summary(days)._jdf.queryExecution(), "simple")
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_set_moves_as_one(spark):
    root = new_path(spark, "set")
    upsert.publish_set({"a": spark.range(1), "b": spark.range(2)}, root, "v1")

    class Lost(Exception):
        pass

    class Fails:
        sparkSession = spark

        @property
        def write(self):
            raise Lost

    with pytest.raises(Lost):
        upsert.publish_set({"a": spark.range(10), "b": Fails()}, root, "v2")
    assert [upsert.published(spark, root, part=p).count() for p in "ab"] == [1, 2]
    upsert.publish_set({"a": spark.range(10), "b": spark.range(20)}, root, "v3")
    assert [upsert.published(spark, root, part=p).count() for p in "ab"] == [10, 20]


def test_a_write_counts_what_it_saw(spark, days):
    rules = [*lc.error_rules(), *lc.warning_rules()]
    rows, seen = lc.observed(days, rules[1:], rules[:1])
    rows.write.parquet(path := new_path(spark, "observed"))
    want = {r["rule"]: r["failed"] for r in lc.expectation_counts(days, rules).collect()}
    assert {k: n for k, n in seen.get.items() if k != "total"} == want and seen.get["total"] == days.count()
    assert want["missing_title"] > 0 and spark.read.parquet(path).count() == days.count() - want["missing_title"]


def test_large_vocabulary(spark):
    """Ten thousand spellings of one to three words, and a plan that does not grow with them."""
    words = [f"w{i}" for i in range(6000)]
    spelled = {w: w for w in words} | {f"{a} {b}": a for a, b in zip(words, words[1:], strict=False)} | {"x-y z": "xyz"}
    texts = spark.createDataFrame([(i, f"{words[i * 7]}  {words[i * 7 + 1].upper()}, then w{i}zz x-y\tz") for i in range(300)], "k int, x string")
    got = t.mentions(texts, "k", "x", t.vocabulary_table(spark, spelled))
    assert {tuple(r) for r in got.collect()} == {(i, n) for i in range(300) for n in (words[i * 7], words[i * 7 + 1], "xyz")}
    size = lambda v: len(spark._jvm.PythonSQLUtils.explainString(t.mentions(texts, "k", "x", t.vocabulary_table(spark, v))._jdf.queryExecution(), "simple"))
    assert abs(size(spelled) - size({"a": "a", "b c": "b", "x-y z": "xyz"})) < 200


def test_runs_of_words(spark):
    rows = spark.createDataFrame([("One two,  three ONE two",), ("",), (None,), ("--",), ("a-b c",)], "x string")
    got = [sorted(r[0]) if r[0] is not None else None for r in rows.select(t.grams("x", [1, 3])).collect()]
    assert got == [sorted(["one", "two", "three", "one two", "two, three", "three one"]), [], None, [], sorted(["a", "b", "c", "a-b", "b c"])]


def test_filtered_log_is_the_log(spark):
    """A filter on what was found changes nothing but the rows shown."""
    rows = spark.createDataFrame([(1, "uses spark 3", "no"), (2, "ok", "ok"), (3, "x" * 300, None)], "i int, c string, s string")
    log = validate.violations(validate.check_texts(rows, "c", "s", {"spark": "spark"}, key="i"), "i")
    every = {tuple(r) for r in log.collect()}
    assert every == {(1, "new numbers 3"), (1, "new tools spark"), (3, "unknown source"), (3, "too long")}
    assert {tuple(r) for r in log.where("problem LIKE 'new%'").collect()} == {x for x in every if x[1].startswith("new")}
