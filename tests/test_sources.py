"""Landed files, streams and vendor payloads (made up, in the shapes that vendors send)."""

import json

import pytest
from pyspark.sql import functions as F

from snaplake.plans import daily
from snaplake.sources import landing, payloads
from snaplake.storage import drop_path, new_path, only_result_stays, stored
from snaplake.streaming import bronze


def test_stream_twice(spark):
    files, table, checkpoint = (new_path(spark, n) for n in ("in", "out", "cp"))
    rows = spark.createDataFrame([("a", "2026-01-01", "2026-01-01T07:00:00Z"), ("b", "soon", "2026-01-02T07:00:00Z")], "job_key string, snapshot_date string, ingested_at string")
    rows.write.json(f"{files}/one")
    got = bronze.ingest_postings(spark, files, table, checkpoint, landing.POSTING)
    assert [(r["job_key"], str(r["snapshot_day"])) for r in got.orderBy("job_key").collect()] == [("a", "2026-01-01"), ("b", "2026-01-02")]
    assert got.where("source_file IS NULL OR loaded_at IS NULL OR title IS NOT NULL").count() == 0
    assert bronze.ingest_postings(spark, files, table, checkpoint, landing.POSTING).count() == 2
    rows.limit(1).write.json(f"{files}/deeper/two")
    assert bronze.ingest_postings(spark, files, table, checkpoint, landing.POSTING).count() == 3
    assert bronze.full_refresh(spark, files, table, checkpoint, landing.POSTING, "v2").count() == 3
    drop_path(spark, table)


def test_daily_run(spark):
    """Streams to days; a day that lands late extends a lifetime, and what was loaded last is the latest."""
    files, audits, root = (new_path(spark, n) for n in ("in", "runs-in", "house"))
    row = lambda d, title: (title, d, "lever", "c", "t" * 300, f"https://x/{d}", "Pune", "k")
    write = lambda rows: spark.createDataFrame(rows, "title string, snapshot_date string, source string, company string, raw_text string, url string, location string, job_key string").write.mode("append").json(files)
    spark.createDataFrame([("c", "lever", "2026-01-03", 1)], "company string, source string, snapshot_date string, postings int").write.json(audits)
    write([row("2026-01-03", "new")])
    day = daily.run(spark, files, audits, root)
    assert [(r["title"], r["days_seen"], r["is_open"]) for r in day.clean.collect()] == [("new", 1, True)] and day.runs.count() == 1
    write([row("2026-01-01", "late")])
    day = daily.run(spark, files, audits, root)
    (r,) = day.postings.collect()
    assert (r["title"], str(r["first_seen"]), str(r["last_seen"]), r["days_seen"]) == ("late", "2026-01-01", "2026-01-03", 2)
    assert day.quarantine.count() == 0 and sorted((str(r["snapshot_day"]), r["new_postings"]) for r in day.daily.collect()) == [("2026-01-01", 1), ("2026-01-03", 0)]
    assert "raw_text" not in day.postings.columns


def test_rescue(spark):
    lines = ['{"company": "c", "postings": 1}', '{"company": "c", "postings": "many"}', '{"company": "c", "new": 1}', '{"company": "c"', "{}"]
    got = landing.by_contract(spark.createDataFrame([(x,) for x in lines], "value string"), landing.RUN).collect()
    assert [r["rescued"] is not None for r in got] == [False, True, True, True, False]
    assert got[1]["company"] == "c"


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,\n")
    assert landing.csv_table(spark, f"file://{tmp_path}", ["a", "b"]).collect() == [("1", "")]


def records(spark, shape, *bodies):
    raw = spark.createDataFrame([("Acme", "h.example", "S1", json.dumps(b)) for b in bodies], "company string, host string, site string, body string")
    return payloads.normalise(raw, payloads.SHAPES[shape]).collect()


def test_board_shapes(spark):
    (g,) = records(spark, "greenhouse", {"jobs": [{"id": 7, "title": " Dev ", "updated_at": "2026-01-01", "location": {"name": "Pune"}, "absolute_url": "u", "content": "&lt;p&gt;hi&lt;/p&gt;"}]}, {"jobs": []})
    assert (g["source_id"], g["title"], g["raw_text"], g["fetch_mode"]) == ("7", "Dev", "hi", "full")
    (v,) = records(spark, "lever", [{"id": "x", "text": "T", "categories": {"location": "L"}, "descriptionPlain": "d", "lists": [{"text": "Need", "content": "<li>a</li><li>b</li>"}], "additionalPlain": "z", "createdAt": 1767225600000}])
    assert v["raw_text"] == "d\nNeed\n- a\n- b\nz" and v["posted_at"] == "2026-01-01T00:00:00+00:00"
    (v,) = records(spark, "lever", [{"id": "x", "text": "T", "descriptionPlain": "experience < 5 years, > 3", "lists": [{"content": None}, {"text": "a <b", "content": "&lt;p&gt;c&lt;/p&gt;"}]}])
    assert v["raw_text"] == "experience < 5 years, > 3\na <b\nc" and v["posted_at"] is None
    w = records(spark, "workday", *[{"jobPostingInfo": {"title": "T", "location": c, "jobReqId": "R1", "country": {"descriptor": "India"}, "jobDescription": "<p>x</p>"}} for c in ("Pune", "Hyderabad, India", None)])
    assert [r["location"] for r in w] == ["Pune, India", "Hyderabad, India", "India"]
    a = records(spark, "amazon", {"jobs": [{"id_icims": "1", "title": "T", "normalized_location": "Pune, IND", "city": "Pune", "country_code": "IND", "description": "d", "basic_qualifications": "b", "job_path": "/x", "posted_date": "January  5, 2026"}]})
    assert (a[0]["location"], a[0]["raw_text"], a[0]["posted_at"]) == ("Pune, India", "d\nb", "2026-01-05")
    (e,) = records(spark, "eightfold", {"id": 3, "name": "N", "location": "Mumbai,India", "t_create": 1767225600, "job_description": "x"})
    assert (e["source_id"], e["location"], e["posted_at"]) == ("3", "Mumbai, India", "2026-01-01")
    (o,) = records(spark, "oracle", {"items": [{"Id": "9", "Title": "T", "ExternalPostedStartDate": "2026-01-05T00:00", "ExternalDescriptionStr": "a", "ExternalQualificationsStr": "b"}, {"Id": "10"}]})
    assert (o["raw_text"], o["posted_at"], o["url"][-6:]) == ("a\nb", "2026-01-05", "/job/9")


def test_all_shapes_at_once(spark, capsys):
    """A mixed landing table gives what each shape gives alone, in one read, one explode and one pass over the markup."""
    bodies = [
        ("greenhouse", {"jobs": [{"id": 7, "title": " Dev ", "content": "&lt;p&gt;hi &amp;amp; ho&lt;/p&gt;"}, None, {"id": 8}]}), ("greenhouse", {"jobs": []}), ("greenhouse", {}),
        ("lever", [{"id": "x", "text": "T", "lists": [{"text": "Need", "content": "<li>a &amp; b</li>"}]}, {"id": "y"}]), ("lever", []),
        ("workday", {"jobPostingInfo": {"title": "T", "location": "Pune", "jobReqId": "R1", "country": {"descriptor": "India"}, "jobDescription": "<p>x</p>"}}), ("workday", {"other": 1}),
        ("amazon", {"jobs": [{"id_icims": "1", "description": "d &lt;b&gt;e", "basic_qualifications": None, "preferred_qualifications": "f", "posted_date": "January  5, 2026"}]}),
        ("eightfold", {"id": 3, "name": "N", "location": "Mumbai,India", "t_create": 1767225600, "job_description": "x"}),
        ("oracle", {"items": [{"Id": "9", "ExternalDescriptionStr": "a"}, {"Id": "10"}]}), ("nobody", {"jobs": [{"id": 1}]}),
    ]
    made = [("Acme", "h.example", "S1", k, json.dumps(b), "extra") for k, b in bodies] + [("Acme", None, None, "lever", None, None), (None, "h", "s", "greenhouse", "{broken", None), ("c", "h", "s", None, "{}", None)]
    path = new_path(spark, "mixed")
    spark.createDataFrame(made, "company string, host string, site string, source string, body string, t string").write.parquet(path)
    raw = spark.read.parquet(path)
    got = payloads.normalise_all(raw)
    say = lambda df: sorted(map(tuple, df.collect()), key=repr)
    alone = [r for k, shape in payloads.SHAPES.items() for r in say(payloads.normalise(raw.where(raw.source == k).drop("t"), shape))]
    assert say(got) == sorted(alone, key=repr) and len(alone) == 8
    assert {r["source_id"]: r["raw_text"] for r in got.collect()}["7"] == "hi & ho"
    got.explain("formatted")
    plan = capsys.readouterr().out.split("(1)")[0]
    assert [plan.count(x) for x in ("Scan parquet", "Generate", "ArrowEvalPython", "Exchange")] == [1, 1, 1, 0]
    assert payloads.normalise_all(raw.limit(0)).count() == 0


def test_html_shapes(spark):
    page = '<style>.jobTitle-link</style><tr class="data-row"><a class="jobTitle-link" href="/job/1/">A &amp; B</a><span class="jobLocation"> Pune </span></tr><tr class="data-row"><b>no link</b></tr>'
    got = payloads.search_rows(spark.createDataFrame([("c", page)], "company string, html string"), "html").collect()
    assert [(r["path"], r["title"], r["location"]) for r in got] == [("/job/1/", "A & B", "Pune")]
    detail = '<meta itemprop="datePosted" content="Wed Jan 07 00:00:00 UTC 2026"><h1 itemprop="title">Dev</h1><span itemprop="addressLocality" content="Pune"></span><span itemprop="addressCountry" content="IN"></span><div><span class="jobdescription"><p>do</p></span></div>'
    (d,) = payloads.detail_pages(spark.createDataFrame([("c", "h", "/job/12/", detail)], "company string, host string, path string, html string")).collect()
    assert (d["source_id"], d["title"], d["location"], d["raw_text"], d["posted_at"]) == ("12", "Dev", "Pune, India", "do", "2026-01-07")


def test_facets(spark):
    place = lambda n, i: {"descriptor": n, "id": i}
    bodies = {
        "exact": {"facets": [{"facetParameter": "cities", "values": [place("Pune, India", "p")]}, {"facetParameter": "group", "values": [{"facetParameter": "country", "descriptor": "C", "values": [place("India", "i")]}]}]},
        "cities": {"facets": [{"facetParameter": "one", "values": [place("India - X", "a")]}, {"facetParameter": "two", "values": [place("Y, India", "b"), place("India Z", "c"), place("Indiana", "d")]}]},
        "deep": {"facets": [{"facetParameter": "g", "values": [{"facetParameter": "h", "values": [{"facetParameter": "k", "values": [place("Pune, India", "p"), place("Goa, India", "q")]}]}]}]},
        "none": {"facets": [{"facetParameter": "one", "values": [place("Oslo", "o")]}]},
    }
    raw = spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()], "company string, body string")
    assert {r["company"]: (r["parameter"], r["ids"]) for r in payloads.country_facets(raw).collect()} == {"exact": ("country", ["i"]), "cities": ("two", ["b", "c"]), "deep": ("k", ["p", "q"])}


def test_small_tables(spark):
    assert landing.small_table(spark, [("a", 1)], "n string, v int").agg(F.sum("v")).first()[0] == 1


def test_only_the_result_of_a_block_stays(spark):
    with only_result_stays(spark):
        first = stored(spark.range(3), "first")
        (file,) = first.coalesce(1).inputFiles()[:1]
        last = stored(first.selectExpr("id + 1 AS id"), "last")
    assert sorted(r["id"] for r in last.collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="(?i)path|exist|file"):
        spark.read.parquet(file).count()
