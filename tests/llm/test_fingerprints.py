import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from snaplake.llm import fingerprints as fp

SCHEMA = "doc_id long, text string"


def canonical(text):
    n = lambda s: unicodedata.normalize("NFKC", s)
    return re.sub(r"[\s  ]+", " ", n(n(text).casefold())).strip()


TEXTS = ["Straße", "STRASSE", "strasse ", "été", "été", "ÉTÉ", "ﬁne  line", "fine\n\tline", "½", "1⁄2", "ạ̇", "ạ̇", "한글", "한글", "x y", "x y", "", " ", "Å", "Å"]


def test_canonical_form(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)
    got = [r[0] for r in rows.orderBy("doc_id").select(fp.canonical(F.col("text"))).collect()]
    assert got == [canonical(t) for t in TEXTS]


def test_against_brute_force(spark):
    rows = [(3 * i - 7, t) for i, t in enumerate(TEXTS + ["long text " * 50, "other", None])]
    got = {r["doc_id"]: r for r in fp.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    order = sorted(((d, t or "") for d, t in rows), reverse=True)
    classes = {}
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["near_edited"], r["near_next"]) == (float(canonical(edited) == canonical(t)), float(canonical(nxt) == canonical(t)))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (canonical(edited) == canonical(t))
        classes.setdefault(canonical(t), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in classes.values()) and len({next(iter(v)) for v in classes.values()}) == len(classes)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 7)
    rows = [(i * i, f"t{i}") for i in range(400)]
    got = {r["doc_id"]: r["next_text"] for r in fp.with_next(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i * i: f"t{(i - 1) % 400}" for i in range(400)}


def test_unequal_bytes_in_a_bucket_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fp, "wide_hash", lambda form: F.lit("same"))
    rows = [(1, "a"), (2, "b"), (3, "A"), (4, "b ")]
    rows += [(5, "xy"), (6, "yx")]
    all_ = {r["doc_id"]: r for r in fp.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    got = {d: r["fingerprint"] for d, r in all_.items()}
    assert got[1] == got[3] != got[2] == got[4] and len(set(got.values())) == 4
    # an edited text that equals a document has its fingerprint: half of one character is none; 6 (yx) takes the x of 5 (xy)
    assert all(all_[d]["edited_fingerprint"] == got[d] and all_[d]["near_edited"] == 1 for d in (1, 2, 3))
    assert all_[6]["near_edited"] == (all_[6]["edited_fingerprint"] == got[6]) and all_[5]["edited_fingerprint"] not in (got[5], got[6])
    assert all_[3]["near_next"] == 0 and all_[2]["near_next"] == 0


def test_odd_rows(odd, none):
    got = fp.fingerprints(odd).collect()
    assert len(got) == odd.count() and len({r["fingerprint"] for r in got if r["doc_id"] == 1}) == 1
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (2, 3, 4)}) == 1  # null, empty and blank
    assert fp.fingerprints(none).count() == 0


def test_plan_has_no_python(spark, odd):
    for rows in (fp.with_next(odd), fp.fingerprints(odd), fp._collisions(fp._forms(odd, fp.with_next(odd)))):
        assert not re.search("Python|Pandas|Arrow", rows._jdf.queryExecution().toString())
