"""Keyed changes to tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from snaplake.operators import upsert as u
from snaplake.queries.registry import Source, query, text_dates

# the target is the older part of orders, the changes the newer part with some known keys
TARGET = "t AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, CAST(NULL AS VARCHAR) AS note, CASE WHEN o_orderkey % 5 = 0 THEN '2001-01-01' END AS applied_at FROM {orders} WHERE o_orderkey % 3 > 0)"
CHANGES = "c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'APPLIED' ELSE 'HELD' END AS status, o_totalprice + 1 AS price, CASE WHEN o_orderkey % 4 = 0 THEN 'n' END AS note, CAST(NULL AS VARCHAR) AS applied_at FROM {orders} WHERE o_orderkey % 7 < 3)"


def _target(s: Source):
    k = F.col("o_orderkey")
    return s["orders"].where(k % 3 > 0).select(k.alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.lit(None).cast("string").alias("note"), F.when(k % 5 == 0, "2001-01-01").alias("applied_at"))


def _changes(s: Source):
    k = F.col("o_orderkey")
    return s["orders"].where(k % 7 < 3).select(k.alias("k"), F.when(k % 2 == 0, "APPLIED").otherwise("HELD").alias("status"), (F.col("o_totalprice") + 1).alias("price"), F.when(k % 4 == 0, "n").alias("note"), F.lit(None).cast("string").alias("applied_at"))


@query("upsert_all", f"WITH {TARGET}, {CHANGES} SELECT * FROM c UNION ALL SELECT * FROM t WHERE k NOT IN (SELECT k FROM c)")
def _(s: Source):
    return u.upsert_all(_target(s), _changes(s), "k")


@query("insert_new", f"WITH {TARGET}, {CHANGES} SELECT * FROM t UNION ALL SELECT * FROM c WHERE k NOT IN (SELECT k FROM t)")
def _(s: Source):
    return u.insert_new(_target(s), _changes(s), "k")


@query("upsert_guarded", f"WITH {TARGET}, {CHANGES} SELECT k, CASE WHEN t.k IS NULL THEN 'SHORTLISTED' ELSE t.status END AS status, CASE WHEN t.k IS NULL OR (t.status = 'O' AND c.k IS NOT NULL) THEN c.price ELSE t.price END AS price, CASE WHEN t.k IS NULL THEN c.note ELSE t.note END AS note, t.applied_at FROM t FULL JOIN c USING (k)")
def _(s: Source):
    return u.upsert_guarded(_target(s), _changes(s).select("k", "price", "note"), "k", F.col("status") == "O", ["price"], {"status": F.lit("SHORTLISTED")})


@query("update_guarded", f"WITH {TARGET}, {CHANGES} SELECT t.k, t.status, CASE WHEN t.status = 'F' AND c.k IS NOT NULL THEN c.price ELSE t.price END AS price, CASE WHEN t.status = 'F' AND c.k IS NOT NULL THEN c.note ELSE t.note END AS note, t.applied_at FROM t LEFT JOIN c USING (k)")
def _(s: Source):
    return u.upsert_guarded(_target(s), _changes(s).select("k", "price", "note"), "k", F.col("status") == "F", ["price", "note"], inserts=False)


@query("status_transition", f"WITH {TARGET}, {CHANGES} SELECT t.k, coalesce(c.status, t.status) AS status, t.price, coalesce(c.note, t.note) AS note, CASE WHEN c.status = 'APPLIED' AND t.applied_at IS NULL THEN '2020-02-02' ELSE t.applied_at END AS applied_at FROM t LEFT JOIN c USING (k)")
def _(s: Source):
    return u.transition(_target(s), _changes(s), "k", F.lit("2020-02-02"))


@query("link_capture", """WITH leads AS (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END AS url, CASE WHEN page_id % 3 = 0 THEN 'DONE' ELSE 'NEEDS_JD' END AS status, CAST(-1 AS BIGINT) AS job FROM {pages}),
c AS (SELECT rtrim(url, '/') AS u, max(page_id) AS job FROM {pages} GROUP BY 1) SELECT page_id, leads.url, CASE WHEN status = 'NEEDS_JD' AND c.u IS NOT NULL THEN 'CAPTURED' ELSE status END AS status, CASE WHEN status = 'NEEDS_JD' THEN coalesce(c.job, -1) ELSE leads.job END AS job FROM leads LEFT JOIN c ON rtrim(leads.url, '/') = c.u""")
def _(s: Source):
    pages = s["pages"].select("page_id", "url")
    leads = pages.select("page_id", F.concat("url", F.when(F.col("page_id") % 2 == 0, "/").otherwise("")).alias("url"), F.when(F.col("page_id") % 3 == 0, "DONE").otherwise("NEEDS_JD").alias("status"), F.lit(-1).cast("long").alias("job"))
    seen = pages.select("url", F.col("page_id").alias("found"), F.lit("CAPTURED").alias("state"))
    return u.update_matching(leads, seen, F.rtrim("url", F.lit("/")), [F.desc("found")], F.col("status") == "NEEDS_JD", {"status": "state", "job": "found"})


@query("published_version", "SELECT o_orderkey, o_orderstatus FROM {orders}")
def _(s: Source):
    from snaplake.storage import new_path

    root = new_path(s.spark, "published")
    rows = s["orders"].select("o_orderkey", "o_orderstatus")
    u.publish(rows.where("o_orderstatus = 'O'"), root, "v9")
    u.publish(rows, root, "v10")
    return u.published(s.spark, root)


@query("newest_change", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM {orders} GROUP BY o_custkey")
def _(s: Source):
    rows = s["orders"].select("o_custkey", "o_orderkey", "o_orderdate")
    return text_dates(u.one_per_key(rows, "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey"))


def _new_table(s: Source, columns: dict[str, str]) -> str:
    name = f"t_{uuid.uuid4().hex}"
    u.ensure_columns(s.spark, name, columns)
    return name


@query("gold_write", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM {orders}")
def _(s: Source):
    """An older load, then all rows over it, in another order of columns."""
    rows = s["orders"].select("o_totalprice", "o_orderstatus", "o_orderkey")
    name = _new_table(s, {"o_orderkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double"})
    for load in (rows.where("o_orderstatus = 'F'"), rows):
        u.overwrite_by_name(load, name)
    return s.spark.table(name)


@query("columns_added", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS priority FROM {orders}")
def _(s: Source):
    """Rows from before a column was added have none of it."""
    name = _new_table(s, {"O_ORDERKEY": "bigint"})
    rows = s["orders"].select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    u.append_log(rows.join(s["orders"].where("o_orderstatus <> 'O'"), "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("O_ORDERKEY")), name)
    u.ensure_columns(s.spark, name, {"o_orderkey": "bigint", "priority": "string"})
    u.append_log(rows.join(s["orders"].where("o_orderstatus = 'O'"), "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("O_ORDERKEY"), "priority"), name)
    return s.spark.table(name).select(F.col("O_ORDERKEY").alias("o_orderkey"), "priority")


@query("log_appended", "SELECT o_orderstatus AS check_name, 2 * count(*) AS n FROM {orders} GROUP BY 1")
def _(s: Source):
    """A log keeps what each run wrote."""
    name = _new_table(s, {"check_name": "string", "n": "bigint"})
    counts = s["orders"].groupBy(F.col("o_orderstatus").alias("check_name")).agg(F.count("*").alias("n"))
    for _run in range(2):
        u.append_log(counts, name)
    return s.spark.table(name).groupBy("check_name").agg(F.sum("n").alias("n"))
