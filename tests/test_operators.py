"""Operators on small made-up rows: the cases that the given tables don't hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from snaplake.functions import text as t
from snaplake.functions import vocabulary
from snaplake.operators import enrich, fetch_state, lifecycle, rules, score, upsert, validate
from snaplake.plans import metrics, quality_gate, snapshot
from snaplake.storage import new_path, pieces

DAY = dt.date(2026, 1, 10)
SNAP = "job_key string, source string, company string, title string, location string, url string, raw_text string, posted_at string, snapshot_day date, loaded_at timestamp, seq long, fetch_mode string"


def row(key, day, seq, source="lever", title="t", text="x" * 250, mode="full", loaded=None):
    at = loaded or dt.datetime(2026, 1, day, 7)
    return (key, source, "c", title, "Pune", "https://u", text, "2026-01-01", dt.date(2026, 1, day), at, seq, mode)


@pytest.fixture(scope="module")
def snap(spark):
    rows = [
        row("a", 8, 1), row("a", 9, 2, title=None, text=None, mode="seen"), row("b", 8, 3), row("m", 1, 4, source="manual"),
        row("late", 9, 5, title="new"), row("late", 2, 6, title="backfilled", loaded=dt.datetime(2026, 1, 12)),
    ]
    return spark.createDataFrame(rows, SNAP)


def test_lifecycle(snap):
    got = {r["job_key"]: r for r in lifecycle.with_texts(lifecycle.postings(snap), snap).collect()}
    assert got["a"]["title"] is None and got["a"]["raw_text"] == "x" * 250  # the newest null wins, but not over a text
    assert got["a"]["dq_errors"] == ["missing_title"] and got["a"]["is_open"] and not got["b"]["is_open"]
    assert got["m"]["is_open"]
    assert got["late"]["title"] == "backfilled" and got["late"]["first_seen"] == dt.date(2026, 1, 2) and got["late"]["days_seen"] == 2


def test_postings_move_no_texts(snap):
    """The one shuffle by key holds lengths, not texts."""
    plan = lifecycle.postings(snap).select("job_key", "is_open", "dq_errors")._jdf.queryExecution().executedPlan().toString()
    shuffled = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert len(shuffled) == 1 and "max(raw_text" not in plan and "struct(raw_text" not in plan


def test_clean_and_quarantine_are_complements(snap):
    every = lifecycle.postings(snap)
    good, bad = (set(r["job_key"] for r in x.collect()) for x in (lifecycle.clean(every), lifecycle.quarantine(every)))
    assert good | bad == {"a", "b", "m", "late"} and not good & bad
    assert lifecycle.drop_failing(every, lifecycle.error_rules(chars=F.col("text_chars"))).count() == len(good)


def test_postings_without_rows(spark):
    assert lifecycle.postings(spark.createDataFrame([], SNAP)).count() == 0


def test_fetch_plan_ages(spark):
    state = spark.createDataFrame([("lever", "c", r, "t", "l", "u", "p", dt.date(2026, 1, d)) for r, d in (("young", 9), ("week", 3))], "source string, company string, list_ref string, title string, location string, url string, posted_at string, last_full date")
    listing = spark.createDataFrame([("lever", "c", "young"), ("lever", "c", "week"), ("lever", "d", "young"), ("lever", "c", "new")], "source string, company string, list_ref string")
    got = {(r["company"], r["list_ref"]): r for r in fetch_state.fetch_plan(listing, state, F.lit(DAY)).collect()}
    assert got["c", "young"]["fetch_mode"] == "seen" and got["c", "young"]["title"] == "t"
    assert all(got[k]["fetch_mode"] == "fetch" and got[k]["title"] is None for k in (("c", "week"), ("d", "young"), ("c", "new")))


PHRASES = [
    ("red widget governance", ["red widget"]), ("Widget/Gear", ["widget", "gear"]), ("big widget (gear)", ["widget", "gear"]), ("red widget store", ["red widget"]),
    ("red  WIDGET;", ["red widget"]), ("wheel", ["gear"]), ("some odd thing (rare)", ["some odd thing"]), ("widgets", ["widgets"]), ("", []), ("red widget shelf", ["red", "widget shelf"]),
]


def test_canonical_terms(spark):
    vocabulary = ["red", "red widget", "widget", "gear", "widget shelf"]
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PHRASES)] + [(99, None)], "i int, p string")
    got = {r["i"]: r["terms"] for r in t.canonical_terms(rows, "p", vocabulary, {"wheel": "gear"}).collect()}
    assert got.pop(99) is None
    assert got == {i: want for i, (_, want) in enumerate(PHRASES)}


def test_html_and_boilerplate(spark):
    rows = spark.createDataFrame([("&amp;lt;p&amp;gt;A &amp;amp; B&lt;/p&gt;<ul><li>one</li><li class='x'>two</li></ul>",), ("<p>x</p>\n\n\n<p>y</p>",), (None,)], "h string")
    assert [r[0] for r in rows.select(t.html_to_text("h")).collect()] == ["A & B\n - one\n- two", "x\n y", ""]
    long = "d" * 400
    texts = spark.createDataFrame([(long + "About Us more",), ("About Us " + long,), ("short About Us x",), (long[:200] + "About Us" + long + "Equal x",)], "x string")
    got = [r[0] for r in texts.select(t.without_boilerplate("x", ["About Us", "Equal"])).collect()]
    assert got[0] == long and got[1].startswith("About Us") and got[2] == "short About Us x" and got[3].endswith("Equal x")


def test_mentions_need_whole_words(spark):
    rows = spark.createDataFrame([(1, "Red widget, gears"), (2, "red, widget"), (3, "aredwidget"), (4, None)], "k int, x string")
    got = {tuple(r) for r in t.mentions(rows, "k", "x", {"red widget": "rw", "gear": "g", "red": "r"}).collect()}
    assert got == {(1, "rw"), (1, "r"), (2, "r")}


def test_rules(spark):
    places = spark.createDataFrame([("Indiana", 1), ("India - Pune", 2), ("", 3), ("4 Locations", 4), (None, 5)], "l string, i int")
    assert [r["i"] for r in places.where(rules.whole_word("l", "India")).collect()] == [2]
    assert [r["i"] for r in places.where(rules.may_match_place("l", ["pune"])).collect()] == [2, 3, 4, 5]
    ages = spark.createDataFrame([(7,), (30,), (31,), (None,)], "d int").select(rules.age_bucket(F.col("d"))).collect()
    assert [r[0][:3] for r in ages] == ["New", "Rec", "Old", "Old"]


def test_career_platforms(spark):
    rows = [
        ("https://acme.wd103.myworkdayjobs.com/en-US/Careers", "", ("workday", "acme", "wd103", "Careers")), ("https://acme.example/jobs", "<iframe src='https://jobs.lever.co/acme'>", ("lever", "acme", "", "")),
        ("https://jobs.lever.co/one", "https://boards.greenhouse.io/two", ("lever", "one", "", "")), ("https://x.example", "nothing", None), (None, None, None),
        ("https://acme.eightfold.ai/", "", ("eightfold", "", "", "acme")),
    ]
    found = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "i int, u string, h string").select("i", rules.first_match(rules.CAREER_PLATFORMS, "u", "h").alias("m")).orderBy("i").collect()
    assert [tuple(r["m"]) if r["m"] else None for r in found] == [w for _, _, w in rows]


def test_upserts(spark):
    target = spark.createDataFrame([(1, "SHORTLISTED", 5), (2, "APPLIED", 5)], "k int, status string, score int")
    changes = spark.createDataFrame([(1, 9), (2, 9), (3, 9)], "k int, score int")
    got = upsert.upsert_guarded(target, changes, "k", F.col("status") == "SHORTLISTED", ["score"], {"status": F.lit("SHORTLISTED")})
    assert sorted(map(tuple, got.collect())) == [(1, "SHORTLISTED", 9), (2, "APPLIED", 5), (3, "SHORTLISTED", 9)]
    with pytest.raises(Exception, match="k 1 occurs more than once"):
        upsert.assert_unique(changes.union(changes.where("k = 1")), "k").collect()
    assert upsert.insert_new(target.select("k", "score"), changes.union(changes), "k").count() == 3


def test_columns_are_added(spark):
    spark.sql("DROP TABLE IF EXISTS grown")
    assert upsert.ensure_columns(spark, "grown", {"a": "int"}) == ["a"]
    upsert.append_log(spark.createDataFrame([(1,)], "a int"), "grown")
    assert upsert.ensure_columns(spark, "grown", {"A": "int", "b": "string"}) == ["b"]
    upsert.overwrite_by_name(spark.createDataFrame([("x", 2)], "b string, a int"), "grown")
    assert [tuple(r) for r in spark.table("grown").collect()] == [(2, "x")]
    spark.sql("DROP TABLE grown")


def test_score_thresholds(spark):
    p = score.Profile(have=["a", "b"], learning=["l"], shown=["a"], equivalent={"c": ["b"]}, years=5, places=["pune"], domains=["bank"])
    skills = spark.createDataFrame([(1, "must", "a", 1), (1, "must", "c", 2), (2, "must", "l", 1), (2, "nice", "a", 1), (3, "nice", "x", 1)], "job_key int, requirement string, skill string, place int")
    meta = spark.createDataFrame([(1, 5.0, "Pune", "", "Banking"), (2, 8.0, None, None, None), (3, float("nan"), "Oslo", "", "")], "job_key int, years_min double, location string, work_mode string, domain string")
    got = {r["job_key"]: r for r in score.fit(skills, meta, p).collect()}
    assert got[1]["fit_score"] == 100.0 and got[1]["recommendation"] == "APPLY" and got[1]["matched_skills"] == ["a", "c"]
    assert got[2]["fit_score"] == 20.0 and got[2]["missing_skills"] == ["l"] and got[2]["learning_gaps"] == ["l"] and got[2]["location_part"] == 0.5
    assert got[3]["fit_score"] == 15.0 and got[3]["years_part"] == 1.0


def test_actions(spark):
    p = score.Profile(have=list("abcdefg"), learning=["l"], shown=list("bcdefg"), equivalent={}, years=1, places=[], domains=[])
    counts = spark.createDataFrame([(s, n, n + 1) for s, n in zip("abcdefglxy", (9, 8, 7, 6, 5, 4, 3, 2, 3, 2), strict=True)], "skill string, must_postings long, all_postings long")
    got = {r["skill"]: r["priority"] for r in score.actions(counts, p).collect()}
    assert got == {"a": 2, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1, "g": 5, "l": 3, "x": 4, "y": 6}


def test_generated_texts(spark):
    rows = spark.createDataFrame([(1, "cut 20 with spark", "cut 20"), (2, "cut 30", "cut 20"), (3, " ", "s"), (4, "x", None), (5, "fine", "also fine"), (6, "y" * 261, "s")], "i int, c string, s string")
    got = {r["i"]: (r["problems"], r["final"]) for r in validate.check_texts(rows, "c", "s", {"spark": "spark"}).collect()}
    assert got[1] == (["new tools spark"], "cut 20") and got[2] == (["new numbers 30"], "cut 20") and got[3] == (["empty text"], "s")
    assert got[4][0] == ["unknown source"] and got[4][1] is None and got[5] == ([], "fine") and got[6] == (["too long"], "s")
    heads = spark.createDataFrame([("Senior engineer", "engineer"), ("engineer", "engineer")], "h string, t string")
    assert [r["final"] for r in validate.check_headlines(heads, "h", "t").collect()] == ["engineer", "engineer"]


def test_tools_of_several_words(spark):
    tools = vocabulary.tool_spellings("medallion architecture")
    rows = spark.createDataFrame(
        [(1, "built structured streaming", "built jobs", []), (2, "used Power BI", "used powerbi", []), (3, "in Unity  Catalog", "in it", ["UC"]), (4, "with spark streaming", "with spark", []), (5, "tuned sparks", "tuned", [])],
        "i int, c string, s string, tags array<string>",
    )
    got = {r["i"]: r["problems"] for r in validate.check_texts(rows, "c", "s", tools, tags="tags").collect()}
    assert got == {1: ["new tools structured streaming"], 2: [], 3: [], 4: ["new tools structured streaming"], 5: []}


# phrases as postings write them, and the names they stand for
GOLDEN = {
    "Databricks SQL": ["sql warehouse"], "Delta Lake tables": ["delta lake"], "Apache Spark (PySpark)": ["spark", "pyspark"], "Spark/PySpark": ["spark", "pyspark"], "Azure Data Lake Storage": ["azure"],
    "Unity Catalog governance": ["unity catalog"], "Python programming": ["python"], "Strong SQL": ["sql"], "Medallion architecture (Bronze/Silver/Gold)": ["medallion architecture"], "Databricks Workflows": ["databricks workflows"],
    "ETL pipelines": ["etl"], "Lakehouse architecture": ["databricks"], "Data Lakehouse": ["databricks"], "Azure Databricks": ["databricks"], "PySpark": ["pyspark"], "Databricks Asset Bundles (DABs)": ["databricks asset bundles"],
    "CI/CD pipelines": ["ci/cd"], "Git/GitHub": ["git"], "Performance optimization": ["performance tuning"], "Query optimization": ["performance tuning"], "Data quality frameworks": ["data quality"],
    "Dimensional data modeling": ["dimensional modelling"], "Kimball": ["dimensional modelling"], "Power BI dashboards": ["power bi"], "Healthcare data": ["healthcare"], "HIPAA compliance": ["hipaa"],
    "Big Data technologies": ["big data"], "Databricks Genie": ["databricks", "genie"], "LLM integration": ["llm"], "Delta Live Tables": ["delta live tables"], "Synapse": ["synapse"], "Kafka": ["kafka"], "Spark Streaming": ["structured streaming"],
    "Some Niche Tool": ["some niche tool"], "spark sql warehouse": ["spark", "sql warehouse"],
}


def test_golden_phrases(spark):
    rows = spark.createDataFrame(list(GOLDEN.items()), "p string, want array<string>")
    got = {r["p"]: r["terms"] for r in t.canonical_terms(rows, "p", [*vocabulary.MARKET_TERMS], vocabulary.ALIASES).collect()}
    assert got == GOLDEN


def test_mentions_of_signs(spark):
    rows = spark.createDataFrame([(1, "We use CI/CD, and\n ci  cd"), (2, "T-SQL"), (3, "ci/cdx"), (4, "pl/sql")], "k int, x string")
    spelled = {"ci/cd": "ci/cd", "sql": "sql", "t-sql": "sql", "pl/sql": "sql"}
    assert {tuple(r) for r in t.mentions(rows, "k", "x", spelled).collect()} == {(1, "ci/cd"), (2, "sql"), (4, "sql")}
    with pytest.raises(ValueError, match="c\\+\\+"):
        t.mentions(rows, "k", "x", {"c++": "c++"})


def test_phrases_to_score(spark):
    """Names in the order of the phrases, one that is asked for twice matched twice."""
    rows = spark.createDataFrame([(1, "must", 1, "Kafka or Spark/PySpark"), (1, "must", 2, "Strong SQL"), (1, "must", 3, "apache spark"), (1, "nice", 1, "SQL, Power BI")], "job_key int, requirement string, place int, phrase string")
    skills = score.canonical_skills(rows, vocabulary.MARKET_TERMS, vocabulary.ALIASES)
    p = score.Profile(have=["pyspark", "sql"], learning=["kafka"], shown=[], equivalent=vocabulary.EQUIVALENT, years=3, places=["pune"], domains=[])
    meta = spark.createDataFrame([(1, 3.0, "Pune", "", "")], "job_key int, years_min double, location string, work_mode string, domain string")
    (r,) = score.fit(skills, meta, p).collect()
    assert r["matched_skills"] == ["spark", "pyspark", "sql", "sql"] and r["missing_skills"] == ["kafka"] and r["learning_gaps"] == ["kafka"]
    assert r["must_coverage"] == 0.75 and r["nice_coverage"] == 0.5


def test_changes_name_a_key_once(spark):
    target = spark.createDataFrame([(1, "a", None, None)], "k int, status string, note string, applied_at string")
    twice = spark.createDataFrame([(1, "b", "n"), (1, "c", "n")], "k int, status string, note string")
    for new in (lambda: upsert.upsert_all(target.select("k", "status", "note"), twice, "k"), lambda: upsert.upsert_guarded(target, twice, "k", F.lit(True), ["status"]), lambda: upsert.transition(target, twice, "k", F.lit("x"))):
        with pytest.raises(Exception, match="k 1 occurs more than once"):
            new().collect()


def test_the_last_published_version_counts(spark):
    root = new_path(spark, "versions")
    for n in (9, 10):
        upsert.publish(spark.range(n), root, f"v{n}")
    assert upsert.published(spark, root).count() == 10
    with pytest.raises(ValueError, match="landing"):
        fetch_state.export_state(spark.range(1), f"{root}/in/state", f"{root}/in", "v1")


def test_warnings_are_of_clean_postings(spark):
    rows = spark.createDataFrame([("a", ["x"], ["w"], True), ("b", [], ["w"], True), ("c", [], [], True), ("d", [], [], False)], "job_key string, dq_errors array<string>, dq_warnings array<string>, is_open boolean")
    none = spark.createDataFrame([], "failed boolean")
    snap = spark.createDataFrame([("lever", None)], "source string, snapshot_day date")
    checks = quality_gate.standard_checks(rows, rows.where("size(dq_errors) = 0"), none, rows.where("job_key = 'b'"), none, snap, F.lit("2026-01-01").cast("date"))
    got = {r["check_name"]: (round(r["value"], 3), r["detail"]) for r in quality_gate.log_rows(quality_gate.run(checks)).collect()}
    assert got["warning_rate"] == (0.333, "1 of 3 clean postings have a warning") and got["quarantine_rate"] == (0.25, "1 of 4 postings quarantined")
    assert got["open_postings_without_score"][0] == 1 and got["fresh_board_snapshot_days"][0] == 999 and got["enrichment_error_rate_24h"] == (0.0, "0 errors, 0 successes")


def test_fingerprint():
    """The version has to change with the prompt, the schema or the fields: so does this name."""
    assert enrich.fingerprint("a") != enrich.fingerprint("b") != enrich.fingerprint("b", "x STRING") != enrich.fingerprint("b", "x STRING", "s") and len(enrich.fingerprint("a")) == 12


def test_metric_names_are_checked(spark):
    view = metrics.MetricView(spark.createDataFrame([("a", 1), ("b", 2)], "g string, secret int"), {"g": F.col("g")}, {"n": F.count("*")})
    assert view.query(["g"], ["n"], "g = 'a'").collect() == [("a", 1)]
    for bad in (lambda: view.query(["secret"], ["n"]), lambda: view.query(["g"], ["m"])):
        with pytest.raises(KeyError):
            bad()
    with pytest.raises(Exception, match="secret"):
        view.query(["g"], ["n"], "secret = 1").collect()


def test_additive_measures_agree_at_any_grain(spark, sf_dir):
    from snaplake.queries.market import market
    from snaplake.queries.registry import Source

    s = Source(spark, sf_dir)
    view = metrics.job_market(market(s), s.as_of())
    total = view.query([], ["postings", "open_postings"]).first()
    for dims in (["city"], ["company", "is_open"], ["domain", "seniority"]):
        parts = view.query(dims, ["postings", "open_postings"]).agg(F.sum("postings"), F.sum("open_postings")).first()
        assert tuple(parts) == tuple(total)


MARKET = "company string, city string, domain string, seniority string, work_mode string, recommendation string, is_open boolean, is_enriched boolean, from_largest_company boolean, posting_age string, title string, source string, first_seen date, days_since_posted int, fit_score double, years_required double"


def market_rows(spark, n):
    pick = lambda i, *of: of[i % len(of)]
    rows = [
        (pick(i, "a", "b", None, "c"), pick(i, "Pune", None, "Goa"), pick(i, "X", "Y"), None, "", pick(i, "APPLY", "SKIP", None, "STRETCH", "SKIP"), pick(i, True, True, False), pick(i, True, False), pick(i, True, False, False, False), "new", f"t{i % 9}",
         pick(i, "lever", "manual", "workday"), dt.date(2026, 1, 1 + i % 20), i % 60, pick(i, 42.3, 42.4, None, 70.0, 0.0), pick(i, 3.0, None, 5.0, 8.0, 1.5))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, MARKET)


def test_a_cube_gives_what_the_market_gives(spark):
    """Every measure at every kind of grain, with null dimensions and values, from one aggregate."""
    rows, as_of = market_rows(spark, 240), F.lit(dt.date(2026, 1, 20))
    direct, cube = metrics.job_market(rows, as_of), metrics.market_from_cube(metrics.market_cube(rows, as_of))
    everything = list(direct.measures)
    say = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for dims, where in ([], None), (["city"], None), (["company", "seniority"], "is_open"), (["first_seen_week", "source_platform"], "is_enriched AND NOT from_largest_company"), (["title", "posting_age"], "city = 'Pune'"), ([], "city = 'Oslo'"):
        got = say(cube.query(dims, everything, where))
        assert got == say(direct.query(dims, everything, where)) and got
    # a mean that lies on a tie goes up in both
    tie = rows.where("fit_score IN (42.3, 42.4)")
    assert metrics.market_from_cube(metrics.market_cube(tie, as_of)).query([], ["avg_fit_score"]).first()[0] == 42.4
    few = metrics.market_from_cube(metrics.market_cube(rows, as_of, ["city"]))
    assert say(few.query(["city"], everything)) == say(direct.query(["city"], everything))
    with pytest.raises(KeyError):
        few.query(["title"], ["postings"])
    empty = rows.limit(0)
    assert say(metrics.market_from_cube(metrics.market_cube(empty, as_of)).query([], everything)) == say(metrics.job_market(empty, as_of).query([], everything))


def test_panels_read_the_market_once(spark, sf_dir, capsys):
    from snaplake.queries.market import PANELS, market
    from snaplake.queries.registry import Source
    from snaplake.storage import stored

    s = Source(spark, sf_dir)
    made = metrics.market_cube(market(s), s.as_of())
    made.explain("formatted")
    assert capsys.readouterr().out.split("(1)")[0].count("Scan parquet") <= 5  # snapshots twice, and each of what is joined to them
    panels = metrics.long_panels(metrics.market_from_cube(stored(made, "cube")), PANELS)
    panels.explain("formatted")
    said = capsys.readouterr().out
    assert "events" not in said and {r["panel"] for r in panels.select("panel").distinct().collect()} == set(PANELS)


def test_gate_and_export(spark):
    log = spark.createDataFrame([("a", 1, True, True), ("a", 2, False, True), ("b", 1, False, False)], "check_name string, checked_at int, passed boolean, blocking boolean")
    shut = quality_gate.gate_state(log, F.desc("checked_at"))
    assert shut.first()["failed_blocking"] == 1
    root = new_path(spark, "export")
    with pytest.raises(RuntimeError, match="1 blocking"):
        snapshot.export({"x": log}, shut, root, "v1")
    opened = quality_gate.gate_state(log.where("checked_at = 1"), F.desc("checked_at"))
    snapshot.export({"x": log}, opened, root, "v1")
    assert upsert.published(spark, root, part="x").count() == 3


def test_checks_are_inclusive(spark):
    rows = spark.createDataFrame([(1,), (2,)], "v int")
    got = quality_gate.run([quality_gate.Check("c", rows, F.max("v"), 2, True), quality_gate.Check("d", rows, F.max("v"), 1, True), quality_gate.Check("e", rows.where("v > 9"), F.max("v"), 2, True, 999.0)]).collect()
    assert {r["check_name"]: r["passed"] for r in got} == {"c": True, "d": False, "e": False}


def test_replies(spark):
    rows = spark.createDataFrame([(1, "{}"), (2, None), (3, '{"title": "t'), (4, "boom")], "job_key int, p string")

    def model(p):
        if p == "boom":
            raise RuntimeError("boom")
        return p

    got = {r["job_key"]: r["error"] for r in enrich.parsed(enrich.infer(rows, "p", model)).collect()}
    assert got == {1: None, 2: "empty response", 3: "response was not valid JSON", 4: "boom"}


def test_entities_leave_alone(spark):
    """Only runs with an ``&`` go to Python, and what comes back is what ``html.unescape`` makes of the whole text, twice."""
    import html
    import random

    r = random.Random(1)
    bits = ["&", "&amp;", "&amp", "lt;", "&lt;", "&gt", "#38;", "&#x26;", "&#60;", "&#", "&notit;", " ", "\t", "<", "a", "\U0001f600", "b;", ";", "&nbsp;", "&Tab;", "&amp;amp;lt;", "\n", "&" + "z" * 40 + ";"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(2000)] + ["x" * 1000 + "&amp; y"]
    rows = spark.createDataFrame([(x, [x, "", x]) for x in texts], "h string, l array<string>")
    put = lambda x: t._put(x, t._decoded(t._entities(x)))
    assert all(g == html.unescape(html.unescape(h)) for h, g in rows.select("h", put(F.col("h"))).collect())
    assert all(g == [one, "", one] for one, g in rows.select(t.html_to_text("h"), t.html_to_texts(F.col("l"))).collect())
    assert rows.select(F.max(F.length(F.array_join(t._entities(F.col("h")), "")))).first()[0] < 1000


def test_industries_are_what_the_patterns_say(spark):
    """Words looked for as bytes find what the patterns find."""
    import re

    from snaplake.operators import rules

    words = ["Health", "e-commerce", "ecommerce", "commerce", "iam", "xiam", "IAM.", "oil", "ai", "said", "it services", "n/a", "", "cloud", "é", "capital market", "none"]
    texts = [a + sep + b for a in words for b in words for sep in (" ", "", "\n")]
    for pattern in [p for _, p in rules.INDUSTRIES] + [rules.TECHNOLOGY, r"a\.c|x+y|(p|q)r{2}"]:
        got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", rules.found(F.lower("x"), pattern)).collect()
        assert all(g == bool(re.search(pattern, x.lower())) for x, g in got), pattern
    plan = spark._jvm.PythonSQLUtils.explainString(spark.createDataFrame([("a",)], "x string").select(rules.industry("x"))._jdf.queryExecution(), "simple")
    assert "bank|financ" not in plan


def test_only_likely_runs_are_made(spark):
    """A text's runs that start with no spelling's first word are not made."""
    known = t.vocabulary_table(spark, {"ci/cd": "ci/cd", "spark sql": "spark sql", "spark": "spark"})
    rows = spark.createDataFrame([("-ci/cd, spark sql xspark ci spark",), ("no word of it",), ("",), (None,)], "x string")
    got = [r[0] and sorted(r[0]) for r in rows.select(t.likely_runs("x", known)).collect()]
    assert got == [["ci spark", "ci/cd", "spark", "spark sql"], [], [], None]


def test_prompts_are_held_a_few_at_a_time(spark):
    """A null prompt gets an error as any that the model refuses; replies keep their rows over many pieces of a batch."""
    def model(x):
        return None if x.endswith("7") else x + "!"

    rows = spark.range(500).select("id", F.when(F.col("id") != 3, F.col("id").cast("string")).alias("p")).coalesce(1)
    got = {r["id"]: tuple(r["r"]) for r in enrich.infer(rows, "p", model).collect()}
    assert len(got) == 500 and got[3][0] is None and "NoneType" in got[3][1]
    assert all(got[i] == (None if i % 10 == 7 else f"{i}!", None) for i in range(500) if i != 3) and enrich.AT_ONCE < 500


def test_skills_are_dealt_once(spark, sf_dir):
    """Once dealt by posting, skills are told apart, joined and counted where they are; only counts of skills are shuffled again, and no row is copied for a second count."""
    from snaplake.queries import QUERIES

    for name in ("mv_skill_demand", "mv_skill_by_domain"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        above, found, _ = plan.partition("REPARTITION_BY_NUM")
        assert found and "Expand" not in plan and [x for x in above.split("\n") if "Exchange hash" in x][1:] == [x for x in above.split("\n") if "Exchange hashpartitioning(job_key" in x], plan


def test_pieces_grow_with_tables(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [pieces(spark.range(0), rows=10), pieces(spark.range(5), spark.range(10 * least), rows=10), pieces(spark.range(5), spark.range(1001), rows=10)] == [least, least, 101]


def test_skill_demand_of_odd_rows(spark):
    rows = [("a", "x", "must", "d"), ("a", "x", "nice", "d"), ("a", "y", "nice", "d"), ("a", "x", "must", "e"), ("b", "x", None, None), (None, "x", "must", "d"), (None, "y", "must", None)]
    made = spark.createDataFrame(rows, "job_key string, skill string, requirement string, domain string").selectExpr("*", "skill = 'x' AS in_profile", "true AS on_learning_list", "'' AS location", "true AS is_open", "true AS known_skill")
    view = metrics.skill_demand(made)
    ask = lambda dims, where=None: sorted(map(tuple, view.query(dims, ["postings_asking", "must_have_postings"], where).collect()), key=repr)
    assert ask(["skill", "skill_status"]) == [("x", "Have it", 2, 1), ("y", "Learning", 1, 0)]
    assert ask(["domain"]) == [("d", 1, 1), ("e", 1, 1), (None, 1, 0)]
    assert ask([]) == [(2, 1)] and ask([], "skill = 'y'") == [(1, 0)] and ask([], "skill = 'z'") == [(0, 0)]
    assert view.query(["skill"], ["postings_asking"]).columns == ["skill", "postings_asking"]


def test_fit_is_dealt_by_posting(spark, sf_dir):
    """Rows that share a phrase are not gathered: the few phrases are sent to them; then a posting's names are told apart, ordered and scored in one place."""
    from snaplake.queries import QUERIES

    rows = QUERIES["fit_score"](spark, sf_dir)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    joins = [x for x in plan.split("\n") if "Join" in x and "__phrase" in x]
    assert joins and all("BroadcastHashJoin" in x for x in joins), plan
    names = plan[: plan.index("REPARTITION_BY_NUM")]
    assert "hashpartitioning(job_key" in plan and "requirement" in names and not [x for x in names.split("\n") if "hashpartitioning" in x and "requirement" in x], plan


def test_refusal_makes_nothing(spark, sf_dir, monkeypatch):
    from snaplake.queries import QUERIES, market

    monkeypatch.setattr(market, "market", lambda s: pytest.fail("made for nobody"))
    assert QUERIES["snapshot_refused"](spark, sf_dir).first()["published"] == 1


def test_export_makes_postings_once(spark, sf_dir, monkeypatch):
    """Postings are rebuilt once for all sets, and skills that lines repeat change none of them."""
    from snaplake.queries import QUERIES, scoring
    from snaplake.queries.registry import Source

    made, of = [], lifecycle.postings
    monkeypatch.setattr(lifecycle, "postings", lambda *a, **k: made.append(1) or of(*a, **k))
    QUERIES["snapshot_export"](spark, sf_dir)
    assert len(made) == 1
    s, groups = Source(spark, sf_dir), {"tools": ["rod"], "parts": ["hot", "gear"]}
    often, once = scoring.market_demand(s, scoring.asked(s)), scoring.market_demand(s)
    assert often.count() > once.count() and snapshot.skills(often).collect() == snapshot.skills(once).collect()
    rows = s["reqmeta"].withColumn("is_enriched", F.lit(True))
    assert snapshot.skill_flags(rows, often, groups).collect() == snapshot.skill_flags(rows, once, groups).collect()


def test_top_members_are_told_apart_in_place(spark, sf_dir):
    from snaplake.queries import QUERIES

    plan = QUERIES["top20_members"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and not [x for x in plan.split("\n") if "Exchange hashpartitioning(job_key" in x and "requirement" in x.partition("), ")[0]], plan


@pytest.mark.parametrize("name", ["mv_skill_by_domain", "top20_members"])
def test_large_joins_are_dealt(spark, sf_dir, monkeypatch, name):
    """Lines meet parts, and postings companies, in partitions of bounded rows where the second table is large, a small one is sent to all; rows are the same."""
    from snaplake import fixtures, storage
    from snaplake.queries import QUERIES

    ask = lambda: sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()))
    dealt = lambda: [x for x in QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n") if "REPARTITION_BY_NUM" in x]
    keys = ("l_partkey", "p_partkey", "o_custkey", "c_custkey")
    sent = ask()
    assert sent and not any(k in x for x in dealt() for k in keys)
    monkeypatch.setattr(fixtures, "dealt_alike", lambda *sides: storage.dealt_alike(*sides, rows=100))
    assert all(any(f"({k}#" in x and ", 60)" in x or f"({k}#" in x and ", 15)" in x for x in dealt()) for k in keys), dealt()
    assert ask() == sent
