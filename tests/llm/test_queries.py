"""Registered queries against their SQL."""

import hashlib

import pytest

from snaplake import fixtures
from snaplake.llm import oracle, queries
from tests.llm import test_pii, test_secrets
from tests.test_queries import duck, rows_of  # noqa: F401


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_equal(spark, sf_dir, duck, name):  # noqa: F811
    got, want = queries.QUERIES[name](spark, sf_dir), duck.sql(oracle.SQL[name])
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name, brute, kinds", [("op2_secret_scan", test_secrets.brute, ["assign", "access", "hex"]), ("op10_personal_data", test_pii.brute, ["email", "ip", "card", "phone"])])
def test_spans_of_every_text(spark, sf_dir, name, brute, kinds):
    """Base counts and digests of all rows against plain patterns; the method only adds to them."""
    text = {r["doc_id"]: r["text"] or "" for r in fixtures.frame(spark, sf_dir, "documents").collect()}
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == len(text)
    for r in rows:
        base = brute(text[r["doc_id"]])
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[0] == k for x in base) for k in kinds]
        spans = r["spans"].split(",") if r["spans"] else []
        assert [x for x in spans if x.split(":")[0] in kinds] == joined and len(spans) == r["n_spans"]
        assert [int(x.split(":")[1]) for x in spans] == sorted(int(x.split(":")[1]) for x in spans)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.SQL)))
def test_runs(spark, sf_dir, name):
    n = fixtures.frame(spark, sf_dir, "documents").count()
    assert queries.QUERIES[name](spark, sf_dir).count() >= n
