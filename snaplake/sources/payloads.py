"""Vendor payloads to one record shape.

Each shape is a schema, a path to its items, the markup in them and a column for each field.  Raw responses land as rows ``company, host, site, source, body``;
:func:`normalise_all` turns them into records.  Nothing here calls a network.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.functions.text import html_to_text, html_to_texts, without_boilerplate
from snaplake.operators.rules import place, stable_key, whole_word
from snaplake.storage import Scratch

FIELDS = ["job_key", "source", "source_id", "company", "title", "location", "url", "raw_text", "posted_at", "list_ref", "fetch_mode"]


def _blank(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")


def _joined(parts: Column) -> Column:
    """Parts that say something, a line each."""
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


@dataclass(frozen=True)
class Shape:
    """``schema`` of the body ``b``, its ``items`` (an array), the ``markup`` in an item ``i`` (an array of strings), and the fields of an item whose markup has become the texts ``t``."""

    source: str
    schema: str
    items: Callable[[str], Column]
    markup: Callable[[str], Column]
    fields: Callable[[str, Column], dict[str, Column]]


def normalise(raw: DataFrame, shape: Shape) -> DataFrame:
    """Records of one shape; a body without items gives none."""
    return normalise_all(raw.withColumn("source", F.lit(shape.source)), [shape])


def normalise_all(raw: DataFrame, shapes: Sequence[Shape] | None = None) -> DataFrame:
    """Records of responses whose ``source`` names their shape: one read, one explode and one pass over all markup, however many shapes there are.

    Each body is parsed by its own shape's schema alone.  Items of all shapes share one column, with a member for each shape.
    A source without a shape and a body without items give no record; other columns of ``raw`` than ``company, host, site, source, body`` are left out.
    """
    shapes = list(SHAPES.values()) if shapes is None else list(shapes)
    kept = ["source", *[c for c in ("company", "host", "site") if c in raw.columns]]
    bodies = raw.select(*kept, *[F.when(F.col("source") == s.source, F.from_json("body", s.schema)).alias(f"b_{s.source}") for s in shapes])
    item = {s.source: bodies.select(s.items(f"b_{s.source}").alias("x")).schema["x"].dataType.elementType for s in shapes}
    member = lambda s, x: F.struct(*[(x if o is s else F.lit(None).cast(item[o.source])).alias(o.source) for o in shapes])
    rows = bodies.select(*kept, F.explode(_by_source(shapes, lambda s: F.transform(F.filter(s.items(f"b_{s.source}"), lambda x: x.isNotNull()), lambda x: member(s, x)))).alias("i"))
    rows = rows.withColumn("t", html_to_texts(_by_source(shapes, lambda s: s.markup(f"i.{s.source}"))))
    fields = {s.source: s.fields(f"i.{s.source}", F.col("t")) for s in shapes}
    of = lambda n: _by_source(shapes, lambda s: fields[s.source][n].cast("string"))
    rows = rows.select("company", "source", *[F.btrim(_blank(of(n))).alias(n) for n in ("title", "location")], *[_blank(of(n)).alias(n) for n in ("url", "raw_text")], F.coalesce(of("source_id"), F.lit("None")).alias("source_id"), of("posted_at").alias("posted_at"))
    return rows.select(stable_key("source", "company", "source_id").alias("job_key"), "source", "source_id", "company", "title", "location", "url", "raw_text", "posted_at", F.col("source_id").alias("list_ref"), F.lit("full").alias("fetch_mode"))


def _by_source(shapes: Sequence[Shape], column: Callable[[Shape], Column]) -> Column:
    """The column of the shape that a row's ``source`` names."""
    return F.coalesce(*[F.when(F.col("source") == s.source, column(s)) for s in shapes])


def _utc(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def _iso(millis: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


GREENHOUSE = Shape(
    "greenhouse",
    "jobs array<struct<id: bigint, title: string, updated_at: string, location: struct<name: string>, absolute_url: string, content: string>>",
    lambda b: F.col(f"{b}.jobs"),
    lambda i: F.array(f"{i}.content"),
    lambda i, t: {"source_id": F.col(f"{i}.id"), "title": F.col(f"{i}.title"), "location": F.col(f"{i}.location.name"), "url": F.col(f"{i}.absolute_url"), "raw_text": t[0], "posted_at": F.col(f"{i}.updated_at")},
)


def _lever_lists(i: str) -> Column:
    return F.coalesce(f"{i}.lists", F.array().cast("array<struct<text: string, content: string>>"))


def _lever_fields(i: str, contents: Column) -> dict[str, Column]:
    # list contents are markup; plain parts are not, and a sign like < in them is part of the text
    lists = F.flatten(F.zip_with(F.transform(_lever_lists(i), lambda p: _blank(p["text"])), contents, lambda a, b: F.array(a, b)))
    body = F.concat(F.array(_blank(f"{i}.descriptionPlain")), lists, F.array(_blank(f"{i}.additionalPlain")))
    at = F.col(f"{i}.createdAt")
    return {"source_id": F.col(f"{i}.id"), "title": F.col(f"{i}.text"), "location": F.col(f"{i}.categories.location"), "url": F.col(f"{i}.hostedUrl"), "raw_text": F.array_join(F.filter(body, lambda p: p != ""), "\n"), "posted_at": F.when(at != 0, _iso(at))}


LEVER = Shape(
    "lever",
    "array<struct<id: string, text: string, categories: struct<location: string>, hostedUrl: string, descriptionPlain: string, lists: array<struct<text: string, content: string>>, additionalPlain: string, createdAt: bigint>>",
    lambda b: F.col(b),
    lambda i: F.transform(_lever_lists(i), lambda p: p["content"]),
    _lever_fields,
)

WORKDAY = Shape(
    "workday",
    "jobPostingInfo struct<title: string, jobDescription: string, location: string, startDate: string, jobReqId: string, jobPostingId: string, externalUrl: string, country: struct<descriptor: string>>",
    lambda b: F.array(f"{b}.jobPostingInfo"),
    lambda i: F.array(f"{i}.jobDescription"),
    lambda i, t: {
        "source_id": F.coalesce(f"{i}.jobReqId", f"{i}.jobPostingId"), "title": F.col(f"{i}.title"), "location": place(f"{i}.location", f"{i}.country.descriptor"), "url": F.col(f"{i}.externalUrl"),
        "raw_text": without_boilerplate(t[0], [F.concat(F.lit("About "), F.col("company")), "Equal Employment Opportunity", "Equal Opportunity Employer"]), "posted_at": F.col(f"{i}.startDate"),
    },
)


def _amazon_fields(i: str, t: Column) -> dict[str, Column]:
    where = F.coalesce(F.nullif(f"{i}.normalized_location", F.lit("")), f"{i}.location", F.lit(""))
    abroad = (F.col(f"{i}.country_code") == "IND") & ~F.contains(F.lower(where), F.lit("india"))
    return {
        "source_id": F.coalesce(f"{i}.id_icims", f"{i}.id"), "title": F.col(f"{i}.title"), "location": F.when(abroad, F.concat(F.coalesce(F.nullif(f"{i}.city", F.lit("")), where), F.lit(", India"))).otherwise(where),
        "url": F.concat(F.lit("https://www.amazon.jobs"), _blank(f"{i}.job_path")), "raw_text": _joined(t),
        "posted_at": F.try_to_timestamp(F.regexp_replace(F.btrim(f"{i}.posted_date"), r"\s+", " "), F.lit("MMMM d, yyyy")).cast("date"),
    }


AMAZON = Shape(
    "amazon",
    "jobs array<struct<id_icims: string, id: string, title: string, normalized_location: string, location: string, city: string, country_code: string, description: string, basic_qualifications: string, preferred_qualifications: string, job_path: string, posted_date: string>>",
    lambda b: F.col(f"{b}.jobs"),
    lambda i: F.array(*[f"{i}.{c}" for c in ("description", "basic_qualifications", "preferred_qualifications")]),
    _amazon_fields,
)

EIGHTFOLD = Shape(
    "eightfold",
    "id bigint, name string, location string, t_create bigint, ats_job_id string, canonicalPositionUrl string, job_description string",
    lambda b: F.array(b),
    lambda i: F.array(f"{i}.job_description"),
    lambda i, t: {
        "source_id": F.coalesce(F.nullif(f"{i}.ats_job_id", F.lit("")), F.col(f"{i}.id").cast("string")), "title": F.col(f"{i}.name"), "location": F.replace(F.replace(_blank(f"{i}.location"), F.lit(","), F.lit(", ")), F.lit("  "), F.lit(" ")), "url": F.col(f"{i}.canonicalPositionUrl"),
        "raw_text": without_boilerplate(t[0], [F.concat(F.lit("At "), F.col("company"), F.lit(", we")), "We are an equal opportunity employer"]), "posted_at": F.when(F.col(f"{i}.t_create") != 0, _utc(F.col(f"{i}.t_create"))),
    },
)

ORACLE = Shape(
    "oracle",
    "items array<struct<Id: string, Title: string, PrimaryLocation: string, ExternalPostedStartDate: string, ExternalDescriptionStr: string, ExternalResponsibilitiesStr: string, ExternalQualificationsStr: string>>",
    lambda b: F.slice(f"{b}.items", 1, 1),
    lambda i: F.array(*[f"{i}.External{p}Str" for p in ("Description", "Responsibilities", "Qualifications")]),
    lambda i, t: {
        "source_id": F.col(f"{i}.Id"), "title": F.col(f"{i}.Title"), "location": F.col(f"{i}.PrimaryLocation"), "url": F.concat(F.lit("https://"), F.col("host"), F.lit("/hcmUI/CandidateExperience/en/sites/"), F.col("site"), F.lit("/job/"), F.col(f"{i}.Id")),
        "raw_text": without_boilerplate(_joined(t), [F.concat(F.lit("About "), F.col("company")), "About Us", "Equal Opportunity Employer"]),
        "posted_at": F.nullif(F.left(_blank(f"{i}.ExternalPostedStartDate"), F.lit(10)), F.lit("")),
    },
)

SHAPES = {s.source: s for s in (GREENHOUSE, LEVER, WORKDAY, AMAZON, EIGHTFOLD, ORACLE)}


# How the pages of one platform mark rows, links, places, descriptions and their closing lines.
ROW, LINK, WHERE = r'<tr[^>]*class="data-row', r'(?s)<a[^>]*class="jobTitle-link[^"]*"[^>]*href="([^"]+)"[^>]*>(.*?)</a>', r'(?s)<span class="jobLocation[^"]*">\s*([^<]*?)\s*</span>'
DESCRIPTION = r'(?s)<span class="jobdescription">(.*?)</span>\s*</div>'


def search_rows(pages: DataFrame, html: str, row: str = ROW, link: str = LINK, where: str = WHERE) -> DataFrame:
    """Result rows of an HTML page: ``path, title, location``, in page order."""
    rows = pages.select("*", F.posexplode(F.slice(F.split(html, row), 2, 1 << 30)).alias("place", "part")).where(F.col("part").rlike(link))
    squeeze = lambda c: F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))
    return rows.select(*[c for c in pages.columns if c != html], "place", F.regexp_extract("part", link, 1).alias("path"), squeeze(html_to_text(F.regexp_extract("part", link, 2))).alias("title"), squeeze(F.regexp_extract("part", where, 1)).alias("location"))


def item_property(html: str, name: str) -> Column:
    """The value of a schema.org property: its ``content``, else the text after the tag."""
    content, text = (F.regexp_extract(html, p, 1) for p in (rf'itemprop="{name}"[^>]*content="([^"]*)"', rf'itemprop="{name}"[^>]*>\s*([^<]*)<'))
    return F.btrim(F.regexp_replace(F.when(F.col(html).rlike(rf'itemprop="{name}"[^>]*content="'), content).otherwise(text), r"(?U)\s+", " "))


def detail_pages(raw: DataFrame, countries: dict[str, str] | None = None) -> DataFrame:
    """Records of HTML detail pages (``company, host, path, html``)."""
    names = F.create_map(*[F.lit(x) for kv in (countries or {"IN": "India"}).items() for x in kv])
    text = without_boilerplate(html_to_text(F.regexp_extract("html", DESCRIPTION, 1)), [F.concat(F.lit("What "), F.col("company"), F.lit(" offers")), F.concat(F.col("company"), F.lit(" | Building a better")), "Equal Opportunity Employer"])
    code = item_property("html", "addressCountry")
    # the weekday in front can't be parsed and says nothing
    day = F.try_to_timestamp(F.regexp_replace(item_property("html", "datePosted"), r"^\w+\s+", ""), F.lit("MMM dd HH:mm:ss zzz yyyy")).cast("date").cast("string")
    rows = raw.select("company", F.lit("successfactors").alias("source"), F.coalesce(F.nullif(F.regexp_extract("path", r"/([0-9]+)/?$", 1), F.lit("")), "path").alias("source_id"), item_property("html", "title").alias("title"), F.concat_ws(", ", F.nullif(item_property("html", "addressLocality"), F.lit("")), F.nullif(F.coalesce(F.element_at(names, code), code), F.lit(""))).alias("location"), F.concat(F.lit("https://"), F.col("host"), F.col("path")).alias("url"), text.alias("raw_text"), day.alias("posted_at"))
    return rows.select(stable_key("source", "company", "source_id").alias("job_key"), *FIELDS[1:9], F.col("source_id").alias("list_ref"), F.lit("full").alias("fetch_mode"))


def facet_places(raw: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``company, path, parameter, name, id`` of every place in nested facets (``company, body``).

    A value that has values is a group, whose own parameter is theirs.  Bodies are parsed once; each round opens the groups that the last one has found and
    writes what is in them, until there are none, so facets may nest to any depth.
    """
    scratch = scratch or Scratch(raw.sparkSession)
    of = lambda c, name, kind: F.try_variant_get(c, f"$.{name}", kind)
    level = raw.select("company", F.posexplode(of(F.try_parse_json("body"), "facets", "array<variant>")).alias("p", "f"))
    level = level.select("company", F.array("p").alias("path"), of(F.col("f"), "facetParameter", "string").alias("parameter"), of(F.col("f"), "values", "array<variant>").alias("values"))
    places = None
    while True:
        one = level.select("company", "path", "parameter", F.posexplode("values").alias("q", "v")).withColumn("path", F.concat("path", F.array("q")))
        one = one.select("company", "path", "parameter", *[of(F.col("v"), n, "string").alias(n) for n in ("descriptor", "id", "facetParameter")], of(F.col("v"), "values", "array<variant>").alias("values"))
        one = scratch.stored(one, "facets")
        leaf = one.where(F.col("values").isNull()).select("company", "path", "parameter", F.col("descriptor").alias("name"), "id")
        places = leaf if places is None else places.unionByName(leaf)
        groups = one.where(F.col("values").isNotNull())
        if groups.isEmpty():
            return places
        level = groups.select("company", "path", F.col("facetParameter").alias("parameter"), "values")


def country_facets(raw: DataFrame, country: str = "India", places: DataFrame | None = None) -> DataFrame:
    """``company, parameter, ids``: the value that is the country, else all values of the facet that holds most places in it.  ``places`` are those of ``raw``, if they are known."""
    every = facet_places(raw) if places is None else places
    every = every.withColumn("exact", F.lower(F.btrim("name")) == country.lower()).where(F.col("exact") | whole_word("name", country))
    place = F.struct("path", "id")
    per = every.groupBy("company", "parameter").agg(F.count_if(~F.col("exact")).alias("n"), F.min("path").alias("first"), F.min(F.when(F.col("exact"), place)).alias("hit"), F.sort_array(F.collect_list(F.when(~F.col("exact"), place))).alias("places"))
    before = F.transform("first", lambda i: -i)
    best = per.groupBy("company").agg(F.min_by(F.struct("parameter", "hit"), F.when(F.col("hit").isNotNull(), F.col("hit"))).alias("e"), F.max_by(F.struct("parameter", "places"), F.struct("n", before)).alias("m"))
    return best.select("company", F.coalesce("e.parameter", "m.parameter").alias("parameter"), F.when(F.col("e.parameter").isNotNull(), F.array("e.hit.id")).otherwise(F.transform("m.places", lambda x: x["id"])).alias("ids"))
