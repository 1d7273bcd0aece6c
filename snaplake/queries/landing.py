"""Ingestion: files are landed in the shared folder, streamed in twice, and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaplake.queries.registry import Source, query, text_dates
from snaplake.sources import landing, payloads
from snaplake.storage import new_path, stored
from snaplake.streaming import bronze

#: The folder a file lies in, which Spark adds as a column.
DAY = T.StructField("day", T.StringType())


@query("bronze_stream", "SELECT job_key, source, company, title, location, url, raw_text, posted_at, fetch_mode, CAST(snapshot_day AS VARCHAR) AS snapshot_day, false AS rescued FROM {snap}")
def _(s: Source):
    files, table, checkpoint = (new_path(s.spark, n) for n in ("landing", "bronze", "bronze-checkpoint"))
    names = ["job_key", "source", "company", "title", "location", "url", "raw_text", "posted_at", "fetch_mode"]
    rows = s["snap"].select(*names, F.date_format("snapshot_day", "yyyy-MM-dd").alias("snapshot_date"))
    bronze.land(rows.withColumn("day", F.col("snapshot_date")), files, "day")
    schema = T.StructType([*landing.POSTING.fields, DAY])
    bronze.ingest_postings(s.spark, files, table, checkpoint, schema)
    again = bronze.ingest_postings(s.spark, files, table, checkpoint, schema)  # finds nothing new
    return text_dates(again.select(*names, "snapshot_day", F.col("rescued").isNotNull().alias("rescued")))


@query("full_refresh", "SELECT CAST(snapshot_day AS VARCHAR) AS snapshot_day, count(*) AS n FROM {snap} GROUP BY snapshot_day")
def _(s: Source):
    """All files again, into a table and a checkpoint of their own."""
    files, table, checkpoint = (new_path(s.spark, n) for n in ("refresh-landing", "refresh", "refresh-checkpoint"))
    rows = s["snap"].select("job_key", "source", F.date_format("snapshot_day", "yyyy-MM-dd").alias("snapshot_date"))
    bronze.land(rows.withColumn("day", F.col("snapshot_date")), files, "day")
    schema = T.StructType([*landing.POSTING.fields, DAY])
    bronze.ingest_postings(s.spark, files, table, checkpoint, schema)
    again = bronze.full_refresh(s.spark, files, table, checkpoint, schema, "v2")
    return text_dates(again.groupBy("snapshot_day").agg(F.count("*").alias("n")))


@query("csv_source", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, '') AS segment FROM {customer}")
def _(s: Source):
    path = new_path(s.spark, "csv")
    s["customer"].select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment")).write.csv(path, header=True)
    return landing.csv_table(s.spark, path, ["c_custkey", "segment"])


@query("fetch_runs", "SELECT company, source, CAST(snapshot_day AS VARCHAR) AS snapshot_day, CAST(postings AS INTEGER) AS postings, CAST(fetched_full AS INTEGER) AS fetched_full, CAST(reused AS INTEGER) AS reused, seconds FROM {runs}")
def _(s: Source):
    files, table, checkpoint = (new_path(s.spark, n) for n in ("run-landing", "runs", "runs-checkpoint"))
    rows = s["runs"].select("company", "source", F.lit("later").alias("snapshot_date"), F.date_format("snapshot_day", "yyyy-MM-dd'T'05:00:00").alias("run_started_at"), "postings", "fetched_full", "reused", "seconds")
    bronze.land(rows.withColumn("day", F.left("run_started_at", F.lit(10))), files, "day")
    out = bronze.ingest_runs(s.spark, files, table, checkpoint, T.StructType([*landing.RUN.fields, DAY]))
    return text_dates(out.select("company", "source", "snapshot_day", "postings", "fetched_full", "reused", "seconds"))


@query("rescued_rows", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'type' WHEN event_id % 5 = 0 THEN 'key' WHEN event_id % 7 = 0 THEN 'broken' END AS why FROM {events} WHERE event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0")
def _(s: Source):
    k = F.col("event_id")
    number = F.when(k % 3 == 0, F.lit('"x"')).otherwise(F.lit("1"))
    line = F.concat(F.lit('{"company": "c", "postings": '), number, F.when((k % 3 > 0) & (k % 5 == 0), F.lit(', "more": 1')).otherwise(F.lit("")), F.when((k % 3 > 0) & (k % 5 > 0) & (k % 7 == 0), F.lit("")).otherwise(F.lit("}")))
    rows = landing.by_contract(s["events"].select("event_id", line.alias("value")), landing.RUN).where(F.col("rescued").isNotNull())
    why = F.when(F.contains("rescued", F.lit('"x"')), "type").when(F.contains("rescued", F.lit("more")), "key").otherwise("broken")
    return rows.select("event_id", why.alias("why"))


@query("payload_records", "SELECT substr(sha1(lower(concat('greenhouse|c', page_id % 10, '|', page_id))), 1, 16) AS job_key, CAST(page_id AS VARCHAR) AS source_id, url, concat('Page ', page_id) AS title, 'Pune' AS location FROM {pages}")
def _(s: Source):
    body = F.to_json(F.struct(F.array(F.struct(F.col("page_id").alias("id"), F.concat(F.lit(" Page "), "page_id").alias("title"), F.struct(F.lit("Pune").alias("name")).alias("location"), F.col("url").alias("absolute_url"), F.col("html").alias("content"))).alias("jobs")))
    raw = s["pages"].select(F.concat(F.lit("c"), F.col("page_id") % 10).alias("company"), body.alias("body"))
    return payloads.normalise(raw, payloads.GREENHOUSE).select("job_key", "source_id", "url", "title", "location")


# responses of each vendor shape over documents: plain signs, escaped markup, dates in the vendor's form
DAY_OF = "CAST(DATE '2026-01-01' + CAST(doc_id % 300 AS INTEGER) AS VARCHAR)"
KEY_OF = "substr(sha1(lower(concat('{source}|c', doc_id % 10, '|', doc_id))), 1, 16) AS job_key"


def _responses(s: Source, body: F.Column, whole: bool = True) -> DataFrame:
    """Rows with ``body`` as JSON, or (not ``whole``) with the members of a struct, which hold it."""
    docs = s["documents"].select("doc_id", F.concat(F.lit("n"), F.length("text").cast("string")).alias("n"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).alias("day"))
    rows = docs.select(F.concat(F.lit("c"), F.col("doc_id") % 10).alias("company"), F.lit("h.example").alias("host"), F.lit("S1").alias("site"), body.alias("said"))
    return rows.select("company", "host", "site", *([F.to_json("said").alias("body")] if whole else ["said.*"]))


def _record_sql(source: str, location: str, text: str, posted: str, url: str, where: str = "true") -> str:
    return f"SELECT {KEY_OF.format(source=source)}, CAST(doc_id AS VARCHAR) AS source_id, concat('T', doc_id) AS title, {location} AS location, {text} AS raw_text, {posted} AS posted_at, {url} AS url, 'full' AS fetch_mode FROM (SELECT doc_id, concat('n', length(text)) AS n FROM {{documents}} WHERE {where})"


RECORD = ["job_key", "source_id", "title", "location", "raw_text", "posted_at", "url", "fetch_mode"]


def _named(**fields) -> F.Column:
    return F.struct(*[(c if isinstance(c, F.Column) else F.lit(c)).alias(k) for k, c in fields.items()])


def _markup(entity: str = "") -> F.Column:
    return F.concat(F.lit("&lt;p&gt;a &amp;amp; b"), F.expr(entity or "''"), F.lit("&lt;/p&gt;"))


def _greenhouse(markup: F.Column) -> F.Column:
    return _named(jobs=F.array(_named(id=F.col("doc_id"), title=F.concat(F.lit(" T"), "doc_id"), updated_at=F.col("day").cast("string"), location=_named(name="Pune"), absolute_url="u", content=F.concat(markup, F.lit("<p>"), "n", F.lit("</p>")))))


def _lever(markup: F.Column) -> F.Column:
    millis = F.unix_timestamp(F.col("day").cast("timestamp")) * 1000
    lists = F.array(_named(text="Need", content="&lt;li&gt;one&lt;/li&gt;<li>two</li>"))
    return F.array(_named(id=F.col("doc_id").cast("string"), text=F.concat(F.lit("T"), "doc_id"), categories=_named(location="Pune"), hostedUrl="u", descriptionPlain=F.concat(F.lit("x < 5, > 3 "), "n"), lists=lists, additionalPlain="y &amp; z", createdAt=millis))


def _workday(markup: F.Column) -> F.Column:
    place = F.when(F.col("doc_id") % 2 == 0, "Pune").otherwise("Remote - India")
    return _named(jobPostingInfo=_named(title=F.concat(F.lit(" T"), "doc_id"), jobDescription=F.concat(markup, F.lit("<p>"), "n", F.lit("</p>")), location=place, startDate=F.col("day").cast("string"), jobReqId=F.col("doc_id").cast("string"), externalUrl="u", country=_named(descriptor="India")))


def _amazon(markup: F.Column) -> F.Column:
    where = F.when(F.col("doc_id") % 2 == 0, "Pune, IND").otherwise("Pune, INDIA")
    return _named(jobs=F.array(_named(id_icims=F.col("doc_id").cast("string"), title=F.concat(F.lit("T"), "doc_id"), normalized_location=where, city="Pune", country_code="IND", description=markup, basic_qualifications=F.col("n"), preferred_qualifications="<b>q</b>", job_path=F.concat(F.lit("/j/"), "doc_id"), posted_date=F.date_format("day", "MMMM  d, yyyy"))))


def _eightfold(markup: F.Column) -> F.Column:
    own = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise("")
    return _named(id=F.col("doc_id"), name=F.concat(F.lit("T"), "doc_id"), location="Pune,India", t_create=F.unix_timestamp(F.col("day").cast("timestamp")), ats_job_id=own, canonicalPositionUrl="u", job_description=F.concat(markup, F.lit("<p>"), "n", F.lit("</p>")))


def _oracle(markup: F.Column) -> F.Column:
    item = _named(Id=F.col("doc_id").cast("string"), Title=F.concat(F.lit("T"), "doc_id"), PrimaryLocation="Pune", ExternalPostedStartDate=F.concat(F.col("day").cast("string"), F.lit("T10:00:00+00:00")), ExternalDescriptionStr=markup, ExternalResponsibilitiesStr=F.col("n"))
    return _named(items=F.array(item, item))


#: For each shape: what a response says, and the SQL of location, text (``<m>`` stands for what the markup says), day and address.
BODIES = {
    "greenhouse": (_greenhouse, "'Pune'", "concat(<m>, chr(10), ' ', n)", DAY_OF, "'u'"),
    "lever": (_lever, "'Pune'", "concat('x < 5, > 3 ', n, chr(10), 'Need', chr(10), '- one', chr(10), '- two', chr(10), 'y &amp; z')", f"concat({DAY_OF}, 'T00:00:00+00:00')", "'u'"),
    "workday": (_workday, "CASE WHEN doc_id % 2 = 0 THEN 'Pune, India' ELSE 'Remote - India' END", "concat(<m>, chr(10), ' ', n)", DAY_OF, "'u'"),
    "amazon": (_amazon, "CASE WHEN doc_id % 2 = 0 THEN 'Pune, India' ELSE 'Pune, INDIA' END", "concat(<m>, chr(10), n, chr(10), 'q')", DAY_OF, "concat('https://www.amazon.jobs/j/', doc_id)"),
    "eightfold": (_eightfold, "'Pune, India'", "concat(<m>, chr(10), ' ', n)", DAY_OF, "'u'"),
    "oracle": (_oracle, "'Pune'", "concat(<m>, chr(10), n)", DAY_OF, "concat('https://h.example/hcmUI/CandidateExperience/en/sites/S1/job/', doc_id)"),
}


def _payload(name: str) -> None:
    body, place, text, *rest = BODIES[name]

    @query(f"payload_{name}", _record_sql(name, place, text.replace("<m>", "'a & b'"), *rest))
    def _(s: Source):
        return payloads.normalise(_responses(s, body(_markup())), payloads.SHAPES[name]).select(*RECORD)


for _name in list(BODIES)[1:]:
    _payload(_name)

# every document is a response of one of the six shapes, whose markup has a numbered entity of its own
_MIXED = [(k, v, f"doc_id % {len(BODIES)} = {i}") for i, (k, v) in enumerate(BODIES.items())]


@query("payload_mixed", " UNION ALL ".join(_record_sql(k, v[1], v[2].replace("<m>", "concat('a & b', chr(CAST(65 + doc_id % 26 AS INTEGER)))"), *v[3:], where) for k, v, where in _MIXED))
def _(s: Source):
    """One landed table of all shapes."""
    entity = _markup("concat('&#', 65 + doc_id % 26, ';')")
    said = F.coalesce(*[F.when(F.expr(where), F.to_json(v[0](entity))) for _, v, where in _MIXED])
    source = F.coalesce(*[F.when(F.expr(where), k) for k, _, where in _MIXED])
    landed = stored(_responses(s, F.struct(source.alias("source"), said.alias("body")), whole=False), "responses")
    return payloads.normalise_all(landed).select(*RECORD)


#: Facets of one to twelve groups in groups; a third of them name the country itself.  ``<`` and ``>`` stand for braces.
FACETS = """translate(concat('<"facets": [<"facetParameter": "top", "values": [', repeat('<"facetParameter": "in", "descriptor": "group", "values": [', CAST(page_id % 12 AS INT)),
  '<"descriptor": "Pune, India", "id": "a', page_id, '">', CASE WHEN page_id % 3 = 0 THEN concat(', <"descriptor": " INDIA", "id": "c', page_id, '">') ELSE '' END, ', <"descriptor": "Goa (India)", "id": "b', page_id, '">, <"descriptor": "Indiana", "id": "d">',
  repeat(']>', CAST(page_id % 12 AS INT)), ']>]>'), '<>', concat(chr(123), chr(125)))"""
_OPENED = "unnest(CAST(x AS JSON[])) AS y, generate_subscripts(CAST(x AS JSON[]), 1) AS i"


@query("facets", f"""WITH RECURSIVE top AS (SELECT page_id, unnest(CAST(json_extract({FACETS}, '$.facets') AS JSON[])) AS f FROM {{pages}}),
v AS (SELECT page_id, json_extract_string(f, '$.facetParameter') AS parameter, [0] AS place, json_extract(f, '$.values') AS x FROM top
  UNION ALL SELECT page_id, json_extract_string(y, '$.facetParameter'), list_append(place, CAST(i AS INTEGER)), json_extract(y, '$.values') FROM (SELECT page_id, place, {_OPENED} FROM v) WHERE json_extract(y, '$.values') IS NOT NULL),
leaf AS (SELECT page_id, parameter, list_append(place, CAST(i AS INTEGER)) AS place, json_extract_string(y, '$.descriptor') AS name, json_extract_string(y, '$.id') AS id FROM (SELECT page_id, parameter, place, {_OPENED} FROM v) WHERE json_extract(y, '$.values') IS NULL),
m AS (SELECT *, lower(trim(name)) = 'india' AS exact FROM leaf WHERE regexp_matches(lower(name), '(^|[^a-z])india($|[^a-z])'))
SELECT page_id, min(parameter) AS parameter, coalesce(min(id) FILTER (exact), string_agg(id, '|' ORDER BY place)) AS ids, max(len(place)) - 2 AS depth FROM m GROUP BY page_id""")
def _(s: Source):
    raw = s["pages"].select("page_id", F.col("page_id").cast("string").alias("company"), F.expr(FACETS).alias("body"))
    places = payloads.facet_places(raw)
    found = payloads.country_facets(raw, places=places)
    depth = places.groupBy("company").agg((F.max(F.size("path")) - 2).cast("long").alias("depth"))
    return text_dates(found.join(depth, "company").select(F.col("company").cast("long").alias("page_id"), "parameter", "ids", "depth"))


DETAIL = """concat('<h1 itemprop="title"> Page  ', page_id, ' </h1><meta itemprop="addressLocality" content="', CASE WHEN page_id % 2 = 0 THEN 'Pune' ELSE '' END, '"><meta itemprop="addressCountry" content="', CASE WHEN page_id % 3 = 0 THEN 'IN' ELSE 'Norway' END,
  '"><meta itemprop="datePosted" content="Tue Mar ', CASE WHEN page_id % 28 < 9 THEN '0' ELSE '' END, page_id % 28 + 1, ' 00:00:00 UTC 2026"><div><span class="jobdescription">', html, '</span></div>')"""


@query("detail_pages", """SELECT substr(sha1(lower(concat('successfactors|c', page_id % 10, '|', page_id))), 1, 16) AS job_key, CAST(page_id AS VARCHAR) AS source_id, concat('Page ', page_id) AS title,
  concat(CASE WHEN page_id % 2 = 0 THEN 'Pune, ' ELSE '' END, CASE WHEN page_id % 3 = 0 THEN 'India' ELSE 'Norway' END) AS location, concat('https://h.example/job/x/', page_id, '/') AS url,
  concat('2026-03-', CASE WHEN page_id % 28 < 9 THEN '0' ELSE '' END, page_id % 28 + 1) AS posted_at FROM {pages}""")
def _(s: Source):
    raw = s["pages"].select(F.concat(F.lit("c"), F.col("page_id") % 10).alias("company"), F.lit("h.example").alias("host"), F.concat(F.lit("/job/x/"), "page_id", F.lit("/")).alias("path"), F.expr(DETAIL).alias("html"))
    return payloads.detail_pages(raw).select("job_key", "source_id", "title", "location", "url", "posted_at")
