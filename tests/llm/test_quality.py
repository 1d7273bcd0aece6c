import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from snaplake.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)]


texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab\n\t #é😀\x0b\x85 ", max_size=40)), max_size=8)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_figures(values):
    got = [x for _, _, f, _ in quality.measure(pa.array(values, pa.string())) for x in zip(*[f[k].tolist() for k in quality.STATS], strict=True)]
    assert [list(x) for x in got] == [brute(v or "") for v in values]


def filler(k, n=60):
    return " ".join(f"w{k}n{i}" for i in range(n))


def test_frequent_lines(spark):
    shared = filler("s", 200)
    rows = [(i, f"{filler(i)}\n{shared}", "a") for i in range(30)] + [(100 + i, f"{filler(100 + i)}\n{shared}", "b") for i in range(3)] + [(200 + i, shared, "c") for i in range(30)]
    got = {r["doc_id"]: r for r in quality.line_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["kept"] and got[0]["removed_words"] == 0  # the first keeps the line
    assert all(not got[i]["kept"] and got[i]["removed_words"] == 200 for i in range(1, 30))
    assert all(got[i]["kept"] for i in range(100, 103))  # under the limit of its host
    assert [i for i in range(200, 230) if got[i]["kept"]] == [200]  # exact copies are documents: the lines of the first stay


def test_repeated_rows_are_one_document(spark):
    """Rows of one id count once, equal or not; rows without id count each; the SQL agrees."""
    import duckdb

    from snaplake.llm import oracle

    limit, shared = quality.LIMIT, filler("s", 90)
    rows = [(i, f"{filler(i)}\n{shared}", "a") for i in range(limit)]  # at the limit of distinct documents
    rows += rows[:5] * 3 + [(3, f"{shared}\n{filler(77)}\n{shared}", "a"), (4, filler(4), "a")]
    rows += [(i, f"{filler(i)}\n{shared}", "b") for i in range(500, 500 + limit)] + [(500, f"{filler(500)}\n{shared}", "b")] * 2 + [(900, f"{filler(900)}\n{shared}", "b")]  # over it
    rows += [(None, f"{filler(600 + i)}\n{shared}", "c") for i in range(limit + 1)] + [(700 + i, f"{filler(700 + i)}\n{shared}", None) for i in range(limit)] + [(700, shared, None)]
    got = quality.line_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    cut = {(r["host"], r["doc_id"]) for r in got if r["removed_words"]}
    assert cut == {("hb", i) for i in [*range(501, 500 + limit), 900]}  # in c no row has an id: no first, and the line stays
    duck = duckdb.connect()
    duck.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = duck.sql(f"SELECT doc_id, n_words, kept, removed_words FROM ({oracle.QUALITY})").fetchall()
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_words"], r["kept"], r["removed_words"])) for r in got)


def test_cleaned_texts(spark):
    """Lines above limits go from the texts that stay, in whatever case and spacing; every other byte stays."""
    shared = filler("s", 20)
    rows = [(i, f"{filler(i)}\n\n {shared.upper() if i % 2 else shared}\t\né {filler(i, 5)}\n", "a") for i in range(30)]
    rows += [(100 + i, f"{shared}\n{filler(100 + i)}", "b") for i in range(3)] + [(200, f"{filler(200)}\n{shared}", "a"), (200, f"{filler(200)}\n{shared}", "a"), (300, None, "a")]
    got = sorted(map(tuple, quality.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()))
    want = [r if r[0] == 0 or r[2] == "b" else (r[0], "\n".join(x for x in r[1].split("\n") if " ".join(x.lower().split()) != shared), r[2]) for r in rows if r[1]]
    assert got == sorted(want)
    assert shared not in dict((d, t) for d, t, _ in got)[1].lower()


def test_cleaned_odd_rows(odd, none):
    kept, clean = quality.keep_good(odd), quality.cleaned(odd)
    assert clean.columns == odd.columns and sorted(map(str, clean.collect())) == sorted(map(str, kept.collect())) and quality.cleaned(none).count() == 0


def test_odd_rows(odd, none):
    got = quality.line_verdicts(odd).collect()
    assert len(got) == odd.count() and {r["doc_id"] for r in got if r["n_words"] == 0} == {2, 3, 4}
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in got if r["kept"])
    assert quality.line_verdicts(none).count() == 0 and quality.keep_good(none).count() == 0
