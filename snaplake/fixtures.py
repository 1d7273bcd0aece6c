"""Snapshot-shaped views over the given tables, in SQL that Spark and DuckDB both run.

Braces name given tables or other views: Spark gets DataFrames for them, DuckDB plain names (see :func:`duckdb_with`).
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from snaplake.storage import dealt_alike, table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    # one row per posting and file row, as it lands
    "snap": """
SELECT concat('k', user_id, '-', event_id % 5) AS job_key,
  CASE event_type WHEN 'error' THEN 'manual' WHEN 'click' THEN 'workday' WHEN 'view' THEN 'oracle'
       WHEN 'purchase' THEN 'lever' ELSE 'greenhouse' END AS source,
  concat('c', user_id % 12) AS company,
  CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 31 = 0 THEN ' ' ELSE concat(event_type, ' engineer') END AS title,
  CASE user_id % 9 WHEN 0 THEN 'Bangalore, India' WHEN 1 THEN 'Bengaluru' WHEN 2 THEN 'Hyderabad' WHEN 3 THEN 'Pune, India'
       WHEN 4 THEN 'Gurugram' WHEN 5 THEN 'Remote - India' WHEN 6 THEN '3 Locations' WHEN 7 THEN '' ELSE NULL END AS location,
  CASE WHEN event_id % 37 = 0 THEN 'ftp://x' WHEN event_id % 41 = 0 THEN '' ELSE concat('https://x.example/', event_id) END AS url,
  CASE WHEN event_type = 'view' THEN NULL ELSE repeat('x', CAST(150 + event_id % 200 AS INT)) END AS raw_text,
  concat(CAST(CAST(ts AS DATE) AS STRING), 'T07:00:00Z') AS posted_at,
  CAST(ts AS DATE) AS snapshot_day, ts AS loaded_at, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'seen' WHEN 'signup' THEN NULL ELSE 'full' END AS fetch_mode
FROM {events}""",
    # requirement phrases, two words each
    "req": """
SELECT l.l_orderkey AS job_key, p.p_name AS phrase, split_part(p.p_name, ' ', 1) AS s1, split_part(p.p_name, ' ', 2) AS s2,
       CASE WHEN l.l_returnflag = 'R' THEN 'nice' ELSE 'must' END AS requirement, l.l_linenumber * 1000000 + l.l_partkey AS line
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "reqmeta": """
SELECT o.o_orderkey AS job_key, CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE CAST(o.o_orderkey % 12 AS DOUBLE) END AS years_min,
  c.c_mktsegment AS domain, CASE WHEN o.o_orderkey % 50 = 0 THEN NULL ELSE lower(n.n_name) END AS location,
  o.o_orderstatus = 'O' AS is_open, CAST(o.o_orderdate AS DATE) AS first_seen
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    # what a model has said about two thirds of the postings
    "facts": """
SELECT job_key, seniority, domain, work_mode, years_min, cloud, must_have_skills, fit_score,
  CASE WHEN fit_score >= 70 THEN 'APPLY' WHEN fit_score >= 50 THEN 'STRETCH' ELSE 'SKIP' END AS recommendation FROM (
SELECT DISTINCT concat('k', user_id, '-', event_id % 5) AS job_key,
  CASE user_id % 8 WHEN 0 THEN 'Senior' WHEN 1 THEN 'Sr. level' WHEN 2 THEN 'Lead, Principal' WHEN 3 THEN 'mid-level' WHEN 4 THEN 'Entry level'
       WHEN 5 THEN 'Head of data' WHEN 6 THEN '' ELSE NULL END AS seniority,
  CASE user_id % 11 WHEN 0 THEN 'Healthcare' WHEN 1 THEN 'banking, financial and energy sectors' WHEN 2 THEN 'Insurance' WHEN 3 THEN 'consulting'
       WHEN 4 THEN 'retail' WHEN 5 THEN 'intermediate goods' WHEN 6 THEN 'data and ai' WHEN 7 THEN 'N/A' WHEN 8 THEN 'agriculture' WHEN 9 THEN '' ELSE NULL END AS domain,
  CASE user_id % 3 WHEN 1 THEN 'hybrid' WHEN 2 THEN 'remote' ELSE NULL END AS work_mode,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(user_id % 12 AS DOUBLE) END AS years_min,
  CASE user_id % 5 WHEN 0 THEN split('azure,aws', ',') WHEN 1 THEN split('gcp', ',') ELSE NULL END AS cloud, split(concat('sql,python,s', user_id % 4), ',') AS must_have_skills,
  CAST((user_id * 37 + (event_id % 5) * 11) % 1000 AS DOUBLE) / 10 AS fit_score
FROM {events} WHERE user_id % 3 <> 0) f""",
    # what the profile makes of most of them
    "fits": """
SELECT job_key, fit_score, recommendation, CASE WHEN fit_score >= 60 THEN split('sql,python', ',') ELSE split('sql', ',') END AS matched_skills,
  CASE WHEN fit_score >= 60 THEN NULL ELSE split('python,scala', ',') END AS missing_skills, CASE WHEN fit_score >= 30 THEN NULL ELSE split('scala', ',') END AS learning_gaps
FROM {facts} WHERE job_key NOT LIKE '%-4'""",
    # one row per board and run
    "runs": """
SELECT company, source, CAST(snapshot_day AS DATE) AS snapshot_day, count(*) AS postings,
  count(CASE WHEN fetch_mode = 'seen' THEN NULL ELSE 1 END) AS fetched_full, count(CASE WHEN fetch_mode = 'seen' THEN 1 END) AS reused,
  CAST(count(*) AS DOUBLE) / 4 AS seconds
FROM {snap} GROUP BY company, source, snapshot_day""",
    # a log of checks, one row a day and check
    "checks": """
SELECT concat('check_', user_id % 7) AS check_name, ts AS checked_at, event_id AS seq, CAST(value AS DOUBLE) AS value, event_type <> 'error' AS passed, user_id % 2 = 0 AS blocking
FROM {events}""",
}


# joins of large tables in views: what a task sorts must not grow with them
JOINED = {"req": (("lineitem", "l_partkey"), ("part", "p_partkey")), "reqmeta": (("orders", "o_custkey"), ("customer", "c_custkey"))}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    given = {}
    if name in JOINED:
        (many, key), (few, other) = JOINED[name]
        given = dict(zip((many, few), dealt_alike(table(spark, sf_dir, many), key, table(spark, sf_dir, few), other), strict=True))
    return run(spark, sf_dir, VIEWS[name], given)


def run(spark: SparkSession, sf_dir: str, sql: str, given: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Spark's result of SQL with braces; ``given`` are frames to take for names in them."""
    given = given or {}
    return spark.sql(sql, **{n: given[n] if n in given else frame(spark, sf_dir, n) for n in _needs(sql)})


def duckdb_with(sql: str) -> str:
    """DuckDB SQL in which every view that ``sql`` names in braces is a common table expression in front."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in _needs(text):
            if n in VIEWS and n not in order:
                visit(VIEWS[n])
                order.append(n)

    visit(sql)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    head = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(sql).strip()
    if not head:
        return body
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body):
        return f"WITH {m[1] or ''}{head},\n{body[m.end():]}"
    return f"WITH {head}\n{body}"
