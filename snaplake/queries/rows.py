"""Row rules over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from snaplake.operators import rules as r
from snaplake.operators.score import average
from snaplake.queries.registry import Source, mean_1, query, text_dates


def _sql_cases(column: str, cases, end: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({column}), '{p}') THEN '{n}'" for n, p in cases) + f" {end} END"


@query("keyword_filter", "SELECT p_partkey, p_name FROM {part} WHERE (contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'gear')) AND contains(lower(p_brand), '#1')")
def _(s: Source):
    return s["part"].where(r.matches("p_name", "p_brand", ["BOLT", "Gear"], ["#1"])).select("p_partkey", "p_name")


@query("keyword_filter_trusted", "SELECT p_partkey, p_name FROM {part} WHERE (p_partkey % 5 = 0 OR contains(lower(p_name), 'bolt')) AND contains(lower(p_brand), '#1')")
def _(s: Source):
    trusted = s.spark.createDataFrame([(0, True)], "board long, trusted boolean")
    rows = s["part"].withColumn("board", F.col("p_partkey") % 5).join(F.broadcast(trusted), "board", "left")
    return rows.where(r.matches_or_trusted("p_name", "p_brand", F.coalesce("trusted", F.lit(False)), ["bolt"], ["#1"])).select("p_partkey", "p_name")


@query("prefilter_location", r"SELECT job_key, seq FROM {snap} WHERE coalesce(location, '') = '' OR regexp_matches(lower(location), '^\s*[0-9]+\s+locations\s*$') OR contains(lower(location), 'hyderabad')")
def _(s: Source):
    return s["snap"].where(r.may_match_place("location", ["Hyderabad"])).select("job_key", "seq")


PAGES = [("secure", "^https://([a-z0-9.-]+)/([a-z]*)", ["1", "2"]), ("plain", "^http://([a-z0-9.-]+)", ["1"]), ("listing", "<li><a href=\"([^\"]+)\"", ["1"]), ("article", "<(article|main|p)", ["1"])]


def _classify_sql() -> str:
    def case(text: str, rule) -> str:
        parts = [f"regexp_extract({text}, '{rule[1]}', {g})" for g in rule[2]] + ["''"] * (3 - len(rule[2]))
        return f"WHEN regexp_matches({text}, '{rule[1]}') THEN {{{{'name': '{rule[0]}', 'part1': {parts[0]}, 'part2': {parts[1]}, 'part3': {parts[2]}}}}}"

    cases = " ".join(case(text, rule) for text in ("url", "html") for rule in PAGES).replace("{{", "{ ").replace("}}", " }")
    return f"WITH c AS (SELECT page_id, CASE {cases} END AS m FROM {{pages}}) SELECT page_id, m.name AS name, m.part1 AS part1, m.part2 AS part2, m.part3 AS part3 FROM c"


@query("classify_pages", _classify_sql())
def _(s: Source):
    return s["pages"].select("page_id", r.first_match(PAGES, "url", "html").alias("m")).select("page_id", "m.*")


@query("city_norm", f"SELECT job_key, seq, {_sql_cases('location', r.CITIES, chr(32) + 'ELSE ' + repr('Other'))} AS city FROM {{snap}}")
def _(s: Source):
    return s["snap"].select("job_key", "seq", r.city("location").alias("city"))


@query("level_norm", f"WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Sr. engineer' WHEN 1 THEN 'International lead' WHEN 2 THEN o_orderpriority END AS stated, CASE o_orderkey % 3 WHEN 0 THEN 'intern' WHEN 1 THEN 'head of sales' ELSE 'clerk' END AS title FROM {{orders}}) SELECT o_orderkey, coalesce({_sql_cases('stated', r.LEVELS_STATED, '')}, {_sql_cases('title', r.LEVELS_IN_TITLE, '')}, 'Not stated') AS level FROM t")
def _(s: Source):
    k = F.col("o_orderkey")
    rows = s["orders"].select("o_orderkey", F.when(k % 4 == 0, "Sr. engineer").when(k % 4 == 1, "International lead").when(k % 4 == 2, F.col("o_orderpriority")).alias("stated"), F.when(k % 3 == 0, "intern").when(k % 3 == 1, "head of sales").otherwise("clerk").alias("title"))
    return rows.select("o_orderkey", r.level("stated", "title").alias("level"))


@query("domain_norm", "WITH g AS (SELECT doc_id, text, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in r.INDUSTRIES) + f"], lambda x: x IS NOT NULL) AS gs FROM {{documents}}) SELECT doc_id, CASE WHEN len(gs) > 1 THEN 'Multiple industries' WHEN len(gs) = 1 THEN gs[1] WHEN regexp_matches(lower(text), '{r.TECHNOLOGY}') THEN 'Technology & software' WHEN text IS NULL OR trim(lower(text)) IN (" + ", ".join(f"'{x}'" for x in r.NOT_STATED) + ") THEN 'Not stated' ELSE 'Other' END AS domain FROM g")
def _(s: Source):
    return s["documents"].select("doc_id", r.industry("text").alias("domain"))


@query("age_bucket", "SELECT o_orderkey, CASE WHEN d <= 7 THEN 'New (7 days or less)' WHEN d <= 30 THEN 'Recent (8-30 days)' ELSE 'Older (over 30 days)' END AS age FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-03') END AS d FROM {orders})")
def _(s: Source):
    days = F.when(F.col("o_orderkey") % 11 > 0, F.datediff(F.lit("1998-08-03").cast("date"), F.col("o_orderdate").cast("date")))
    return s["orders"].select("o_orderkey", r.age_bucket(days).alias("age"))


@query("platform_label", "SELECT source, count(*) AS n, coalesce(MAP {'workday': 'Workday', 'greenhouse': 'Greenhouse', 'lever': 'Lever', 'manual': 'Pasted JD'}[source], CASE source WHEN 'oracle' THEN 'Oracle Recruiting' ELSE source END) AS label FROM {snap} GROUP BY source")
def _(s: Source):
    return s["snap"].groupBy("source").agg(F.count("*").alias("n")).withColumn("label", r.labelled("source", r.PLATFORMS))


@query("stable_key", "SELECT event_id, substr(sha1(lower(concat_ws('|', event_type, concat('C', user_id), coalesce(CAST(CASE WHEN event_id % 7 > 0 THEN event_id END AS VARCHAR), 'None')))), 1, 16) AS key FROM {events}")
def _(s: Source):
    rows = s["events"].select("event_id", "event_type", F.concat(F.lit("C"), "user_id").alias("company"), F.when(F.col("event_id") % 7 > 0, F.col("event_id")).alias("i"))
    return rows.select("event_id", r.stable_key("event_type", "company", "i").alias("key"))


@query("null_safe_changes", "SELECT event_id FROM {events} WHERE (CASE WHEN event_id % 3 > 0 THEN event_type END) IS DISTINCT FROM (CASE WHEN event_id % 2 > 0 THEN event_type END)")
def _(s: Source):
    a, b = (F.when(F.col("event_id") % n > 0, F.col("event_type")) for n in (3, 2))
    return s["events"].where(r.differs(a, b)).select("event_id")


@query("blank_default", "SELECT job_key, seq, coalesce(nullif(location, ''), 'unspecified') AS location FROM {snap}")
def _(s: Source):
    return s["snap"].select("job_key", "seq", r.or_default("location", "unspecified").alias("location"))


@query("location_compose", "SELECT job_key, seq, CASE WHEN contains(lower(coalesce(location, '')), 'india') THEN coalesce(location, '') ELSE concat_ws(', ', nullif(location, ''), 'India') END AS place FROM {snap}")
def _(s: Source):
    return s["snap"].withColumn("country", F.lit("India")).select("job_key", "seq", r.place("location", "country").alias("place"))


@query("union_sources", "SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, c_mktsegment AS segment FROM {customer} UNION ALL SELECT s_suppkey, s_name, NULL FROM {supplier} UNION ALL SELECT p_partkey, p_name, NULL FROM {part}")
def _(s: Source):
    return r.union_sources(s["customer"].select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), s["supplier"].select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name")), s["part"].select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("name")))


@query("ordered_distinct", "WITH w AS (SELECT page_id, string_split(url, '/') AS ws FROM {pages}) SELECT page_id, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), '|') AS parts FROM w")
def _(s: Source):
    return text_dates(s["pages"].select("page_id", F.array_distinct(F.split("url", "/")).alias("parts")))


@query("reason_counts", f"SELECT event_type, count(*) AS n, {mean_1('value')} AS avg_value, max(value) AS best, count(*) FILTER (value > 50) AS high FROM {{events}} GROUP BY event_type")
def _(s: Source):
    return s["events"].groupBy("event_type").agg(F.count("*").alias("n"), average("value", 1).alias("avg_value"), F.max("value").alias("best"), F.count_if(F.col("value") > 50).alias("high"))
