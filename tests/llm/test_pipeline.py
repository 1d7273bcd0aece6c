"""The pipeline against a plain version of its decisions."""

import hashlib
from collections import Counter

import corpus_pipeline as cp
from snaplake.llm import mixing, quality, secrets
from tests.llm.test_neardup import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, columns = docs, docs.columns
    kept = [r["doc_id"] for r in quality.line_verdicts(docs).where("kept").collect()]
    docs = cp.keep_good(spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(kept) and docs.columns == columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    docs = cp.one_of_each(spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted({c for _, _, c in brute(rows)}) and docs.columns == columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    docs = cp.cut_secrets(spark, docs, sf_dir)
    for r in docs.collect():
        assert not secrets.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert secrets.base_spans(before[r["doc_id"]]) or secrets.MARK in r["text"] or r["text"] == before[r["doc_id"]]
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    docs = cp.weigh_sources(spark, docs, sf_dir)
    assert Counter(r["doc_id"] for r in docs.collect()) == plan and docs.columns == columns
    out = cp.encode(spark, docs, sf_dir).groupBy("doc_id", "rank").count().collect()
    assert all(r["count"] == plan[r["doc_id"]] for r in out) and {r["doc_id"] for r in out} == set(plan)
    whole = cp.run(spark, sf_dir).select("doc_id", "rank", "n_pieces").collect()
    assert len(whole) == sum(r["count"] for r in out) and len(whole) < 6 * first.count()


def test_quality_stage_cuts_lines(spark):
    line = " ".join(f"shared{i}" for i in range(20))
    rows = [(i, " ".join(f"w{i}n{k}" for k in range(60)) + f"\n{line}", "en", "a", 1) for i in range(30)]
    got = {r["doc_id"]: r for r in cp.keep_good(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), None).collect()}
    assert len(got) == 30 and all((line in r["text"]) == (d == 0) and r["n_chars"] == len(r["text"]) for d, r in got.items())


def test_odd_rows(spark, odd, none, tmp_path):
    for docs in (odd, none):
        names = docs.columns
        for i, (_, stage) in enumerate(cp.STAGES):
            docs = stage(spark, docs, None)
            assert i == len(cp.STAGES) - 1 or docs.columns == names
            docs.write.parquet(f"file://{tmp_path}/{len(names)}-{i}-{docs is odd}-{hashlib.md5(str(docs.schema).encode()).hexdigest()[:4]}", mode="overwrite")
        docs.count()
