"""Snapshots to postings, days and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from snaplake.operators import enrich
from snaplake.operators import fetch_state as fs
from snaplake.operators import lifecycle as lc
from snaplake.operators import rules
from snaplake.plans import quality_gate as gate
from snaplake.operators.upsert import published
from snaplake.queries.registry import Source, query, text_dates
from snaplake.sources.landing import snapshot_day
from snaplake.storage import new_path
from snaplake.streaming import state

ORDER = "loaded_at DESC, snapshot_day DESC, seq DESC"
V = f"v AS (SELECT * FROM {{snap}} QUALIFY row_number() OVER (PARTITION BY job_key ORDER BY {ORDER}) = 1)"
L = "l AS (SELECT job_key, min(snapshot_day) AS first_seen, max(snapshot_day) AS last_seen, count(DISTINCT snapshot_day) AS days_seen FROM {snap} GROUP BY job_key)"
FULL = f"f AS (SELECT job_key, raw_text, posted_at FROM {{snap}} WHERE fetch_mode IS DISTINCT FROM 'seen' QUALIFY row_number() OVER (PARTITION BY job_key ORDER BY {ORDER}) = 1), ff AS (SELECT job_key, max(snapshot_day) AS last_full_fetch FROM {{snap}} WHERE fetch_mode IS DISTINCT FROM 'seen' GROUP BY job_key)"
DAY = "d AS (SELECT max(snapshot_day) AS board_day FROM {snap} WHERE source <> 'manual')"
#: The SQL of one row per posting, as a list of common table expressions that ends in ``allp``.
ALL = f"""{V}, {L}, {FULL}, {DAY},
w AS (SELECT v.job_key, v.source, v.company, v.title, v.location, v.url, first_seen, last_seen, days_seen, f.raw_text, TRY_CAST(left(f.posted_at, 10) AS DATE) AS posted_date, last_full_fetch,
  (v.source = 'manual' OR last_seen >= board_day) AS is_open
  FROM v JOIN l USING (job_key) LEFT JOIN f ON v.job_key = f.job_key LEFT JOIN ff ON v.job_key = ff.job_key CROSS JOIN d),
allp AS (SELECT *,
  list_filter([CASE WHEN title IS NULL OR trim(title) = '' THEN 'missing_title' END, CASE WHEN company IS NULL OR trim(company) = '' THEN 'missing_company' END,
    CASE WHEN raw_text IS NULL OR length(raw_text) < 200 THEN 'short_description' END], lambda x: x IS NOT NULL) AS dq_errors,
  list_filter([CASE WHEN url IS NOT NULL AND url <> '' AND NOT regexp_matches(url, '^https?://') THEN 'invalid_url' END,
    CASE WHEN location IS NULL OR trim(location) = '' THEN 'missing_location' END], lambda x: x IS NOT NULL) AS dq_warnings FROM w),
good AS (SELECT * FROM allp WHERE len(dq_errors) = 0)"""
SHOW = """job_key, source, company, title, location, url, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen, days_seen, raw_text, CAST(posted_date AS VARCHAR) AS posted_date,
  CAST(last_full_fetch AS VARCHAR) AS last_full_fetch, is_open, array_to_string(dq_errors, '|') AS dq_errors, array_to_string(dq_warnings, '|') AS dq_warnings"""


@query("latest_version", f"WITH {V} SELECT job_key, source, company, title, location, url FROM v")
def _(s: Source):
    return lc.latest_version(s["snap"])


@query("lifetime", f"WITH {L} SELECT job_key, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen, days_seen FROM l")
def _(s: Source):
    return text_dates(lc.lifetime(s["snap"]))


@query("latest_full", f"WITH {FULL} SELECT job_key, raw_text, posted_at, CAST(last_full_fetch AS VARCHAR) AS last_full_fetch FROM f JOIN ff USING (job_key)")
def _(s: Source):
    return text_dates(lc.latest_full(s["snap"]))


@query("open_state", f"WITH {V}, {L}, {DAY} SELECT job_key, source, (source = 'manual' OR last_seen >= board_day) AS is_open FROM v JOIN l USING (job_key) CROSS JOIN d")
def _(s: Source):
    return lc.postings(s["snap"]).select("job_key", "source", "is_open")


@query("silver_all", f"WITH {ALL} SELECT {SHOW} FROM allp")
def _(s: Source):
    return text_dates(lc.with_texts(lc.postings(s["snap"]), s["snap"]).drop("text_chars"))


@query("dq_clean", f"WITH {ALL} SELECT {SHOW} FROM good")
def _(s: Source):
    return text_dates(lc.with_texts(lc.clean(lc.postings(s["snap"])), s["snap"]).drop("text_chars"))


@query("dq_quarantine", f"WITH {ALL} SELECT job_key, source, company, title, url, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen, array_to_string(dq_errors, ', ') AS reason, array_to_string(dq_errors, '|') AS dq_errors FROM allp WHERE len(dq_errors) > 0")
def _(s: Source):
    return text_dates(lc.quarantine(lc.postings(s["snap"])))


@query("dq_by_issue", f"WITH {ALL} SELECT x AS issue, count(*) AS postings FROM (SELECT unnest(list_concat(dq_errors, dq_warnings)) AS x FROM allp) GROUP BY x")
def _(s: Source):
    rows = lc.postings(s["snap"]).select(F.explode(F.concat("dq_errors", "dq_warnings")).alias("issue"))
    return rows.groupBy("issue").agg(F.count("*").alias("postings"))


DOCS = "p AS (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE concat('t', doc_id) END AS title, source AS company, text AS raw_text, CASE WHEN doc_id % 7 = 0 THEN 'ftp://x' ELSE '' END AS url, lang AS location FROM {documents})"


def _docs(s: Source):
    return s["documents"].select("doc_id", F.when(F.col("doc_id") % 19 != 0, F.concat(F.lit("t"), "doc_id")).alias("title"), F.col("source").alias("company"), F.col("text").alias("raw_text"), F.when(F.col("doc_id") % 7 == 0, "ftp://x").otherwise("").alias("url"), F.col("lang").alias("location"))


@query("dq_flags", f"""WITH {DOCS} SELECT doc_id, array_to_string(list_filter([CASE WHEN title IS NULL THEN 'missing_title' END, CASE WHEN company IS NULL OR trim(company) = '' THEN 'missing_company' END, CASE WHEN raw_text IS NULL OR length(raw_text) < 200 THEN 'short_description' END], lambda x: x IS NOT NULL), '|') AS dq_errors,
  array_to_string(list_filter([CASE WHEN url = 'ftp://x' THEN 'invalid_url' END, CASE WHEN location IS NULL OR trim(location) = '' THEN 'missing_location' END], lambda x: x IS NOT NULL), '|') AS dq_warnings FROM p""")
def _(s: Source):
    return text_dates(_docs(s).select("doc_id", lc.flags(lc.error_rules()).alias("dq_errors"), lc.flags(lc.warning_rules()).alias("dq_warnings")))


@query("expectation_counts", f"""WITH {DOCS} SELECT * FROM (SELECT 'missing_title' AS rule, count(*) FILTER (title IS NULL) AS failed, count(*) AS total FROM p
  UNION ALL SELECT 'missing_company', count(*) FILTER (company IS NULL OR trim(company) = ''), count(*) FROM p
  UNION ALL SELECT 'short_description', count(*) FILTER (raw_text IS NULL OR length(raw_text) < 200), count(*) FROM p
  UNION ALL SELECT 'invalid_url', count(*) FILTER (url = 'ftp://x'), count(*) FROM p UNION ALL SELECT 'missing_location', count(*) FILTER (location IS NULL OR trim(location) = ''), count(*) FROM p)""")
def _(s: Source):
    return lc.expectation_counts(_docs(s), [*lc.error_rules(), *lc.warning_rules()])


@query("snapshot_day", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM {events}")
def _(s: Source):
    texts = s["events"].select("event_id", F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise("soon").alias("a"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("b"))
    return text_dates(texts.select("event_id", snapshot_day("a", "b").alias("day")))


DROPPED = "title IS NULL OR trim(title) = ''"


@query("expectations_written", f"""WITH {DOCS}, k AS (SELECT * FROM p WHERE NOT coalesce({DROPPED}, false)) SELECT 'missing_company' AS rule, count(*) FILTER (company IS NULL OR trim(company) = '') AS failed, count(*) AS total, (SELECT count(*) FROM k) AS written FROM p
  UNION ALL SELECT 'short_description', count(*) FILTER (raw_text IS NULL OR length(raw_text) < 200), count(*), (SELECT count(*) FROM k) FROM p UNION ALL SELECT 'missing_title', count(*) FILTER ({DROPPED}), count(*), (SELECT count(*) FROM k) FROM p""")
def _(s: Source):
    """Rows are written without those that have no title; the counts of all rules are what that write saw."""
    errors = {r.name: r for r in lc.error_rules()}
    drop = [errors.pop("missing_title")]
    rows, seen = lc.observed(_docs(s), list(errors.values()), drop)
    path = new_path(s.spark, "expected")
    rows.write.parquet(path)
    counts = s.spark.createDataFrame([(k, n) for k, n in seen.get.items() if k != "total"], "rule string, failed long")
    return counts.withColumn("total", F.lit(seen.get["total"])).crossJoin(s.spark.read.parquet(path).agg(F.count("*").alias("written")))


LATE = ALL.replace(ORDER, "(seq % 3 = 0) DESC, snapshot_day DESC, seq DESC")


@query("late_load", f"WITH {LATE} SELECT {SHOW.replace('raw_text, ', 'length(raw_text) AS text_chars, ', 1)} FROM allp")
def _(s: Source):
    """A third of the rows lands after the others, whatever their days, and so is newer; the state follows, and a batch that comes twice counts once."""
    table, root, checkpoint = (new_path(s.spark, n) for n in ("late-bronze", "late-state", "late-checkpoint"))
    rows = s["snap"].withColumn("load", (F.col("seq") % 3 == 0).cast("int"))
    order = lc.recency("load")
    for load in (0, 1):
        rows.where(F.col("load") == load).write.mode("append").parquet(table)
        state.follow(s.spark, table, root, checkpoint, order)
    if state.apply_batch(rows, 0, root, order):
        raise AssertionError("a batch was applied twice")
    out = lc.from_summary(state.follow(s.spark, table, root, checkpoint, order))
    return text_dates(out.withColumn("text_chars", F.col("text_chars").cast("long")).drop("text_version"))


ACTIVITY = """daily AS (SELECT b.snapshot_day, b.company, count(DISTINCT b.job_key) AS open_postings, count(DISTINCT CASE WHEN g.first_seen = b.snapshot_day THEN b.job_key END) AS new_postings
  FROM {snap} b JOIN good g ON b.job_key = g.job_key WHERE b.source <> 'manual' GROUP BY b.snapshot_day, b.company)"""


@query("daily_activity", f"WITH {ALL}, {ACTIVITY} SELECT CAST(snapshot_day AS VARCHAR) AS snapshot_day, company, open_postings, new_postings FROM daily")
def daily_activity(s: Source):
    return text_dates(lc.daily_activity(s["snap"], lc.clean(lc.postings(s["snap"]))))


STATE = f"""r AS (SELECT *, concat('r-', job_key) AS list_ref, concat('s', seq % 3) AS source_id FROM {{snap}} WHERE source IN ('workday', 'oracle') AND seq % 13 > 0),
k AS (SELECT job_key, source, company, list_ref, max(snapshot_day) AS last_seen, max(snapshot_day) FILTER (fetch_mode IS DISTINCT FROM 'seen') AS last_full FROM r GROUP BY ALL),
z AS (SELECT * FROM r WHERE fetch_mode IS DISTINCT FROM 'seen' QUALIFY row_number() OVER (PARTITION BY job_key, source, company, list_ref ORDER BY {ORDER}) = 1),
state AS (SELECT k.job_key, k.source, k.company, k.list_ref, z.source_id, z.title, z.location, z.url, z.posted_at, last_seen, last_full FROM k JOIN z USING (job_key, source, company, list_ref)
  WHERE last_full IS NOT NULL AND last_seen >= (SELECT max(CAST(ts AS DATE)) FROM {{events}}) - INTERVAL 14 DAY)"""


def _state(s: Source):
    rows = s["snap"].withColumns({"list_ref": F.when(F.col("seq") % 13 > 0, F.concat(F.lit("r-"), "job_key")), "source_id": F.concat(F.lit("s"), F.col("seq") % 3)})
    return fs.fetch_state(rows, s.as_of())


STATE_SQL = f"WITH {STATE} SELECT job_key, source, company, list_ref, source_id, title, location, url, posted_at, CAST(last_seen AS VARCHAR) AS last_seen, CAST(last_full AS VARCHAR) AS last_full FROM state"


@query("fetch_state", STATE_SQL)
def _(s: Source):
    return text_dates(_state(s))


@query("exported_state", STATE_SQL)
def _(s: Source):
    root = new_path(s.spark, "fetch-state")
    fs.export_state(text_dates(_state(s)), root, new_path(s.spark, "landing"), "day-9")
    fs.export_state(text_dates(_state(s)), root, new_path(s.spark, "landing"), "day-10")
    return published(s.spark, root, "job_key string, source string, company string, list_ref string, source_id string, title string, location string, url string, posted_at string, last_seen string, last_full string")


@query("fetch_plan", f"""WITH {STATE}, i AS (SELECT DISTINCT source, company, concat('r-', job_key) AS list_ref FROM {{snap}} WHERE source <> 'manual'),
j AS (SELECT i.*, s.title, s.location, s.url, s.posted_at, coalesce(date_diff('day', s.last_full, (SELECT max(CAST(ts AS DATE)) FROM {{events}})) < CASE WHEN i.source = 'oracle' THEN 3 ELSE 7 END, false) AS young FROM i LEFT JOIN state s USING (source, company, list_ref))
SELECT source, company, list_ref, CASE WHEN young THEN 'seen' ELSE 'fetch' END AS fetch_mode, CASE WHEN young THEN title END AS title, CASE WHEN young THEN location END AS location, CASE WHEN young THEN url END AS url, CASE WHEN young THEN posted_at END AS posted_at, CAST(NULL AS VARCHAR) AS raw_text FROM j""")
def _(s: Source):
    listing = s["snap"].where("source <> 'manual'").select("source", "company", F.concat(F.lit("r-"), "job_key").alias("list_ref")).distinct()
    boards = s.spark.createDataFrame([("oracle", f"c{i}", 3) for i in range(12)], "source string, company string, refresh_days int")
    return fs.fetch_plan(listing, _state(s), s.as_of(), 7, boards)


@query("capped_list", """WITH g AS (SELECT source, company, job_key, min(seq) AS o FROM {snap} GROUP BY ALL), r AS (SELECT source, company, job_key, row_number() OVER (PARTITION BY source, company ORDER BY o, job_key) AS rank FROM g)
SELECT source, company, job_key, rank FROM r WHERE rank <= CASE WHEN source = 'lever' THEN 5 ELSE 8 END""")
def _(s: Source):
    return fs.capped_list(s["snap"], ["source", "company"], "job_key", F.col("seq"), F.when(F.col("source") == "lever", 5).otherwise(8)).select("source", "company", "job_key", F.col("rank").cast("long").alias("rank"))


# boards by company: 0 is trusted, 1 has a cap and terms of its own, the others have what is common
@query("board_listing", r"""WITH b AS (SELECT *, company = 'c0' AS trusted, CASE WHEN company = 'c1' THEN 3 ELSE 6 END AS cap FROM {snap} WHERE source <> 'manual'),
k AS (SELECT source, company, job_key AS list_ref, cap, min(seq) AS o FROM b WHERE (trusted OR CASE WHEN company = 'c1' THEN contains(coalesce(title, ''), 'click') ELSE contains(coalesce(title, ''), 'view') OR contains(coalesce(title, ''), 'purchase') END)
  AND (coalesce(location, '') = '' OR regexp_matches(lower(location), '^\s*[0-9]+\s+locations\s*$') OR contains(lower(location), 'india')) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source, company ORDER BY o, list_ref) AS rank FROM k) SELECT source, company, list_ref, rank FROM r WHERE rank <= cap""")
def _(s: Source):
    sources = ["workday", "oracle", "lever", "greenhouse"]
    boards = s.spark.createDataFrame([x for v in sources for x in ((v, "c0", None, None, True, None), (v, "c1", 3, 3, False, ["Click"]))], fs.BOARDS)
    listing = s["snap"].where("source <> 'manual'").select("source", "company", F.col("job_key").alias("list_ref"), "title", "location", "seq")
    return fs.board_listing(listing, boards, ["View", "Purchase"], ["India"], F.col("seq"), 6).withColumn("rank", F.col("rank").cast("long"))


@query("run_audit", "SELECT company, source, count(*) AS postings, count(*) FILTER (fetch_mode IS DISTINCT FROM 'seen') AS fetched_full, count(*) FILTER (fetch_mode = 'seen') AS reused FROM {snap} GROUP BY company, source")
def _(s: Source):
    return fs.run_audit(s["snap"])


@query("runs_latest", "SELECT company, source, postings, fetched_full, reused, seconds FROM {runs} WHERE snapshot_day = (SELECT max(snapshot_day) FROM {runs})")
def _(s: Source):
    runs = s["runs"]
    return runs.join(F.broadcast(runs.agg(F.max("snapshot_day").alias("d"))), F.col("snapshot_day") == F.col("d")).select("company", "source", "postings", "fetched_full", "reused", "seconds")


@query("latest_run", "SELECT CAST(snapshot_day AS VARCHAR) AS snapshot_day, count(*) AS boards FROM {runs} WHERE snapshot_day = (SELECT max(snapshot_day) FROM {runs}) GROUP BY snapshot_day")
def _(s: Source):
    runs = s["runs"].groupBy("snapshot_day").agg(F.count("*").alias("boards"))
    return text_dates(runs.join(F.broadcast(runs.agg(F.max("snapshot_day").alias("d"))), F.col("snapshot_day") == F.col("d")).drop("d"))


@query("runs_daily", "SELECT CAST(snapshot_day AS VARCHAR) AS snapshot_day, CAST(sum(postings) AS BIGINT) AS postings, CAST(sum(fetched_full) AS BIGINT) AS fetched_full, CAST(sum(reused) AS BIGINT) AS reused, sum(seconds) AS seconds FROM {runs} GROUP BY snapshot_day")
def _(s: Source):
    return text_dates(s["runs"].groupBy("snapshot_day").agg(*[F.sum(c).alias(c) for c in ("postings", "fetched_full", "reused", "seconds")]))


@query("loads_daily", "SELECT CAST(snapshot_day AS VARCHAR) AS snapshot_day, source, count(*) AS rows_loaded, count(DISTINCT job_key) AS postings FROM {snap} GROUP BY snapshot_day, source")
def _(s: Source):
    return text_dates(s["snap"].groupBy("snapshot_day", "source").agg(F.count("*").alias("rows_loaded"), F.count_distinct("job_key").alias("postings")))


@query("board_yield", "SELECT source, count(*) AS postings, count(*) FILTER (contains(lower(coalesce(title, '')), 'engineer') AND contains(lower(coalesce(location, '')), 'india')) AS wanted FROM {snap} GROUP BY source")
def _(s: Source):
    rows = s["snap"].fillna("", ["title", "location"])
    return fs.board_yield(rows, rules.matches("title", "location", ["Engineer"], ["India"]))


@query("latest_check", "SELECT check_name, strftime(checked_at, '%Y-%m-%d %H:%M:%S') AS checked_at, seq, value, passed, blocking FROM {checks} QUALIFY row_number() OVER (PARTITION BY check_name ORDER BY checked_at DESC, seq DESC) = 1")
def _(s: Source):
    return text_dates(fs.latest_per_group(s["checks"], "check_name", F.desc("checked_at"), F.desc("seq")))


@query("gate_state", "WITH g AS (SELECT * FROM {checks} QUALIFY row_number() OVER (PARTITION BY check_name ORDER BY checked_at DESC, seq DESC) = 1) SELECT count(*) FILTER (blocking AND NOT passed) AS failed_blocking, strftime(max(checked_at), '%Y-%m-%d %H:%M:%S') AS last_check FROM g")
def _(s: Source):
    return text_dates(gate.gate_state(s["checks"], F.desc("checked_at"), F.desc("seq")))


@query("quality_checks", f"""WITH {ALL}, a AS (SELECT max(CAST(ts AS DATE)) AS as_of FROM {{events}}),
gu AS (SELECT user_id FROM {{events}} WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 3),
ra AS (SELECT count(*) AS n, count(*) FILTER (len(dq_errors) > 0) AS bad FROM allp), rg AS (SELECT count(*) AS n, count(*) FILTER (len(dq_warnings) > 0) AS bad FROM good),
re AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM {{events}} WHERE ts >= (SELECT as_of FROM a) - INTERVAL 1 DAY),
c AS (SELECT 'fresh_board_snapshot_days' AS check_name, CAST(date_diff('day', (SELECT max(snapshot_day) FROM {{snap}} WHERE source <> 'manual'), (SELECT as_of FROM a)) AS DOUBLE) AS value, 2.0 AS threshold, true AS blocking, 'days since the latest board snapshot' AS detail
UNION ALL SELECT 'quarantine_rate', bad / n, 0.25, true, concat(bad, ' of ', n, ' postings quarantined') FROM ra
UNION ALL SELECT 'warning_rate', bad / n, 0.25, false, concat(bad, ' of ', n, ' clean postings have a warning') FROM rg
UNION ALL SELECT 'enrichment_error_rate_24h', bad / n, 0.2, true, concat(bad, ' errors, ', n - bad, ' successes') FROM re
UNION ALL SELECT 'enrichment_given_up', CAST(count(*) AS DOUBLE), 0.0, false, 'skipped after repeated failures' FROM gu
UNION ALL SELECT 'open_postings_without_score', CAST(count(*) AS DOUBLE), 0.0, false, 'waiting for a score' FROM good WHERE is_open AND job_key NOT IN (SELECT job_key FROM {{facts}})
UNION ALL SELECT 'duplicate_postings_in_silver', CAST(count(*) - count(DISTINCT job_key) AS DOUBLE), 0.0, true, 'should be none' FROM good)
SELECT check_name, value, CAST(threshold AS DOUBLE) AS threshold, value <= threshold AS passed, blocking, detail FROM c""")
def _(s: Source):
    every, as_of = lc.postings(s["snap"]), s.as_of()
    log = s["events"].where(F.col("ts") >= F.date_sub(as_of, 1)).select((F.col("event_type") == "error").alias("failed"))
    failed = s["events"].where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 3")
    return gate.run(gate.standard_checks(every, lc.clean(every), log, s["facts"], failed, s["snap"], as_of))


@query("gave_up", "SELECT user_id AS job_key, concat('h', event_id % 2) AS text_hash FROM {events} WHERE event_type = 'error' AND event_id % 5 > 0 GROUP BY ALL HAVING count(*) >= 3")
def _(s: Source):
    log = s["events"].where("event_type = 'error'").select(F.col("user_id").alias("job_key"), F.concat(F.lit("h"), F.col("event_id") % 2).alias("text_hash"), F.when(F.col("event_id") % 5 > 0, "v1").otherwise("v0").alias("prompt_version"), F.lit("m1").alias("llm_model"))
    return enrich.gave_up(log, "v1", "m1")


@query("unscored", f"WITH {ALL} SELECT job_key, company FROM good WHERE is_open AND job_key NOT IN (SELECT job_key FROM {{facts}})")
def _(s: Source):
    return lc.clean(lc.postings(s["snap"])).where("is_open").join(s["facts"], "job_key", "left_anti").select("job_key", "company")
