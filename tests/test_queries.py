"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from snaplake import fixtures
from snaplake.queries import QUERIES, SQL


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in fixtures.TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def held_to_sql(spark, path, names):
    """Whether queries over the tables of a folder give what their SQL gives."""
    con = duckdb.connect()
    for t in os.listdir(path):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{path}/{t}'")
    for name in names:
        got, want = QUERIES[name](spark, str(path)), con.sql(SQL[name])
        assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall()), name


def test_validation_of_odd_rows(spark, tmp_path):
    """Repeated and null keys, blanks inside spellings, a backslash with an s, capital letters with a dot."""
    texts = [(1, "de la 7"), (1, "the 8"), (2, "de la 9 mail"), (2, "de\nla 9 the"), (None, "token 5"), (None, "mail 6"), (3, "public  license"), (4, "public\tlicense 3.5"), (5, "by-nc de\\sla"), (6, None), (7, "maİl " * 90), (8, ""), (9, "public license"), (9, "public license")]
    duckdb.sql("CREATE OR REPLACE TABLE odd_texts (doc_id BIGINT, text VARCHAR)")
    duckdb.executemany("INSERT INTO odd_texts VALUES (?, ?)", texts)
    duckdb.sql(f"COPY odd_texts TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    held_to_sql(spark, tmp_path, ["validate_text", "validate_log"])


def test_entry(spark, sf_dir):
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_braces():
    sql = fixtures.duckdb_with("SELECT * FROM {runs}")
    assert sql.startswith("WITH snap AS (") and "{" not in sql
