"""The market view, metrics at many grains, and public result sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from snaplake.operators import lifecycle as lc
from snaplake.operators.score import average
from snaplake.plans import market as mk
from snaplake.plans import metrics, snapshot
from snaplake.queries import scoring
from snaplake.queries.lifecycle import ACTIVITY, ALL
from snaplake.queries.registry import Source, mean_1, query, text_dates
from snaplake.storage import new_path, stored

_L = "lower({c})"


def _cases(column: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({column}), '{p}') THEN '{n}'" for n, p in rules)


def _market_sql() -> str:
    from snaplake.operators import rules as r

    groups = ", ".join(f"CASE WHEN regexp_matches(lower(f.domain), '{p}') THEN '{n}' END" for n, p in r.INDUSTRIES)
    blank = ", ".join(f"'{x}'" for x in r.NOT_STATED)
    return f"""{ALL}, today AS (SELECT max(CAST(ts AS DATE)) AS as_of FROM {{events}}),
g2 AS (SELECT p.*, f.work_mode, f.years_min AS years_required, f.domain AS domain_detail, f.cloud, f.must_have_skills, t.fit_score, t.recommendation, t.missing_skills, t.learning_gaps, t.matched_skills, f.job_key IS NOT NULL AND t.job_key IS NOT NULL AS is_enriched,
  {_cases("p.location", r.CITIES)} ELSE 'Other' END AS city,
  coalesce({_cases("f.seniority", r.LEVELS_STATED)} END, {_cases("p.title", r.LEVELS_IN_TITLE)} END, 'Not stated') AS seniority,
  list_filter([{groups}], lambda x: x IS NOT NULL) AS gs, date_diff('day', coalesce(p.posted_date, p.first_seen), as_of) AS days_since_posted
  FROM good p LEFT JOIN {{facts}} f ON p.job_key = f.job_key LEFT JOIN {{fits}} t ON p.job_key = t.job_key CROSS JOIN today),
big AS (SELECT company FROM good WHERE is_open GROUP BY company ORDER BY count(*) DESC, company LIMIT 1),
market AS (SELECT g2.*, CASE WHEN len(gs) > 1 THEN 'Multiple industries' WHEN len(gs) = 1 THEN gs[1] WHEN regexp_matches(lower(domain_detail), '{r.TECHNOLOGY}') THEN 'Technology & software'
  WHEN domain_detail IS NULL OR trim(lower(domain_detail)) IN ({blank}) THEN 'Not stated' ELSE 'Other' END AS domain,
  CASE WHEN days_since_posted <= 7 THEN 'New (7 days or less)' WHEN days_since_posted <= 30 THEN 'Recent (8-30 days)' ELSE 'Older (over 30 days)' END AS posting_age,
  company IN (SELECT company FROM big) AS from_largest_company, date_trunc('week', first_seen) AS first_seen_week,
  coalesce(MAP {{{{{", ".join(f"'{k}': '{v}'" for k, v in r.PLATFORMS.items())}}}}}[source], source) AS source_platform FROM g2)"""


MARKET = _market_sql().replace("{{", "{ ").replace("}}", " }")
MEASURES = {
    "postings": "count(*)", "open_postings": "count(*) FILTER (is_open)", "enriched_postings": "count(*) FILTER (is_enriched)", "enrichment_coverage": "count(*) FILTER (is_enriched) / nullif(count(*), 0)",
    "strong_fit_postings": "count(*) FILTER (recommendation = 'APPLY')", "stretch_postings": "count(*) FILTER (recommendation = 'STRETCH')", "companies_with_strong_fit": "count(DISTINCT company) FILTER (recommendation = 'APPLY')",
    "new_this_week": "count(*) FILTER (first_seen >= (SELECT as_of FROM today) - INTERVAL 7 DAY)", "best_fit_score": "max(fit_score)", "older_open_postings": "count(*) FILTER (is_open AND days_since_posted > 30)",
    "strong_fit_rate": "count(*) FILTER (recommendation = 'APPLY') / nullif(count(*) FILTER (is_enriched), 0)", "avg_fit_score": mean_1("fit_score"), "median_years_required": "quantile_cont(years_required, 0.5)",
    "companies": "count(DISTINCT company)", "source_platforms": "count(DISTINCT source) FILTER (source <> 'manual')", "largest_company_share": "count(*) FILTER (from_largest_company) / nullif(count(*), 0)",
}


def market(s: Source):
    return mk.market_view(lc.clean(lc.postings(s["snap"])), s["facts"], s["fits"], s.as_of())


@query("market_view", f"""WITH {MARKET} SELECT job_key, company, title, city, location, work_mode, seniority, years_required, domain, domain_detail, array_to_string(cloud, '|') AS cloud, array_to_string(must_have_skills, '|') AS must_have_skills, fit_score, recommendation, array_to_string(missing_skills, '|') AS missing_skills, array_to_string(learning_gaps, '|') AS learning_gaps, array_to_string(matched_skills, '|') AS matched_skills, is_open, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen,
  days_seen, source, url, is_enriched, CAST(posted_date AS VARCHAR) AS posted_date, days_since_posted, posting_age, CAST(last_full_fetch AS VARCHAR) AS last_full_fetch, from_largest_company FROM market""")
def _(s: Source):
    return text_dates(market(s))


PANELS: dict[str, tuple[list[str], list[str], str | None]] = {}


def _panel(name: str, dims: list[str], measures: list[str], where: str | None = None) -> None:
    PANELS[name] = (dims, measures, where)
    shown = [f"CAST(CAST({d} AS DATE) AS VARCHAR) AS {d}" if d == "first_seen_week" else d for d in dims]
    columns = ", ".join([*shown, *(f"{MEASURES[m]} AS {m}" for m in measures)])
    sql = f"WITH {MARKET} SELECT {columns} FROM market" + (f" WHERE {where}" if where else "") + (f" GROUP BY {', '.join(dims)}" if dims else "")

    @query(name, sql)
    def _(s: Source):
        return text_dates(metrics.job_market(market(s), s.as_of()).query(dims, measures, where))


_panel("mv_market_total", [], list(MEASURES))
_panel("mv_market_by_city", ["city"], list(MEASURES))
_panel("mv_market_by_domain_open", ["domain", "is_open"], ["postings", "enrichment_coverage", "avg_fit_score", "median_years_required", "largest_company_share"])
_panel("mv_market_by_week_platform", ["first_seen_week", "source_platform"], ["postings", "open_postings", "companies"])
_panel("panel_city_open", ["city"], ["open_postings", "companies"], "is_open")
_panel("panel_company_open", ["company"], ["open_postings", "avg_fit_score", "best_fit_score"], "is_open")
_panel("panel_company_strong", ["company"], ["strong_fit_postings", "stretch_postings"], "is_open AND is_enriched")
_panel("panel_domain_stated", ["domain"], ["open_postings", "strong_fit_rate"], "is_open AND is_enriched AND domain <> 'Not stated'")
_panel("panel_seniority_stated", ["seniority"], ["open_postings", "median_years_required"], "is_open AND seniority <> 'Not stated'")
_panel("panel_age_open", ["posting_age"], ["open_postings"], "is_open")
_panel("panel_fresh_by_city", ["city"], ["open_postings", "strong_fit_postings"], "is_open AND posting_age <> 'Older (over 30 days)'")
_panel("panel_fit_bands", ["recommendation"], ["postings", "open_postings"], "is_enriched")
_panel("panel_work_mode", ["work_mode"], ["open_postings", "enriched_postings"], "is_open AND is_enriched")
_panel("panel_platforms", ["source_platform"], ["open_postings", "companies", "source_platforms"], "source_platform <> 'Pasted JD'")
_panel("panel_rest_of_market", ["city"], ["open_postings"], "is_open AND NOT from_largest_company")
_panel("panel_largest_by_domain", ["domain"], ["largest_company_share", "postings"], "is_open")
_panel("panel_week_trend", ["first_seen_week"], ["postings", "new_this_week"])
_panel("panel_titles", ["title"], ["open_postings", "companies"], "is_open")
_panel("panel_health_domains", ["city", "domain"], ["open_postings"], "domain ILIKE '%health%' AND is_open")
_panel("panel_old_open", ["company"], ["older_open_postings"], "is_open")
_panel("panel_median_by_fit", ["recommendation", "seniority"], ["median_years_required", "avg_fit_score"], "is_enriched")
_panel("panel_kpi_open", [], ["open_postings", "companies", "strong_fit_rate", "enrichment_coverage", "largest_company_share"], "is_open")
_panel("panel_coverage_by_company", ["company"], ["enrichment_coverage", "companies_with_strong_fit"])



def _long_sql(name: str, dims: list[str], measures: list[str], where: str | None) -> str:
    shown = [f"coalesce(CAST({f'CAST({d} AS DATE)' if d == 'first_seen_week' else d} AS VARCHAR), '-')" for d in dims]
    values = ", ".join(f"CAST({MEASURES[m]} AS DOUBLE)" for m in measures)
    made = f"SELECT concat_ws('|', {', '.join(shown) or chr(39) * 2}) AS grain, [{values}] AS v FROM market" + (f" WHERE {where}" if where else "") + (f" GROUP BY {', '.join(dims)}" if dims else "")
    return f"SELECT '{name}' AS panel, grain, unnest([{', '.join(f"'{m}'" for m in measures)}]) AS measure, unnest(v) AS value FROM ({made})"


@query("market_panels", f"WITH {MARKET.replace('market AS (', 'market AS MATERIALIZED (')} " + " UNION ALL ".join(_long_sql(k, *v) for k, v in PANELS.items()))
def _(s: Source):
    """All panels from one pass over the market."""
    cube = stored(metrics.market_cube(market(s), s.as_of()), "market-cube")
    return metrics.long_panels(metrics.market_from_cube(cube), PANELS)


DAILY = f"{ALL}, {ACTIVITY}"


def _daily(s: Source):
    return lc.daily_activity(s["snap"], lc.clean(lc.postings(s["snap"])))


@query("mv_daily_week", f"WITH {DAILY} SELECT CAST(CAST(date_trunc('week', snapshot_day) AS DATE) AS VARCHAR) AS week, CAST(sum(new_postings) AS BIGINT) AS new_postings, sum(open_postings) / count(DISTINCT snapshot_day) AS avg_open_postings, count(DISTINCT snapshot_day) AS days_observed FROM daily GROUP BY 1")
def daily_week(s: Source):
    return text_dates(metrics.market_daily(_daily(s)).query(["week"], ["new_postings", "avg_open_postings", "days_observed"]))


@query("mv_daily_company", f"WITH {DAILY} SELECT company, CAST(sum(new_postings) AS BIGINT) AS new_postings, sum(open_postings) / count(DISTINCT snapshot_day) AS avg_open_postings, count(DISTINCT snapshot_day) AS days_observed FROM daily GROUP BY company")
def _(s: Source):
    return metrics.market_daily(_daily(s)).query(["company"], ["new_postings", "avg_open_postings", "days_observed"])


@query("snapshot_daily", f"WITH {DAILY} SELECT CAST(snapshot_day AS VARCHAR) AS day, CAST(sum(open_postings) AS DOUBLE) AS avg_open_postings, CAST(sum(new_postings) AS BIGINT) AS new_postings FROM daily WHERE snapshot_day >= (SELECT max(CAST(ts AS DATE)) FROM {{events}}) - INTERVAL 120 DAY GROUP BY snapshot_day")
def _(s: Source):
    return text_dates(snapshot.daily(_daily(s), s.as_of()))


@query("snapshot_kpis", f"""WITH {MARKET} SELECT {", ".join(f"{MEASURES[m]} AS {m}" for m in ("open_postings", "companies", "median_years_required", "strong_fit_rate", "enrichment_coverage", "largest_company_share"))},
  (SELECT CAST(max(last_seen) AS VARCHAR) FROM market) AS as_of, (SELECT max(CASE WHEN from_largest_company THEN company END) FROM market) AS largest_company FROM market WHERE is_open""")
def _(s: Source):
    return text_dates(snapshot.kpis(market(s), s.as_of()))


@query("snapshot_cities", f"WITH {MARKET} SELECT city, count(*) AS open_postings FROM market WHERE is_open GROUP BY city")
def _(s: Source):
    return snapshot.cities(market(s), s.as_of())


@query("snapshot_domains", f"WITH {MARKET} SELECT domain, count(*) AS open_postings FROM market WHERE is_open AND is_enriched AND domain <> 'Not stated' GROUP BY domain ORDER BY 2 DESC, 1 LIMIT 10")
def _(s: Source):
    return snapshot.domains(market(s), s.as_of())


@query("snapshot_sources", f"WITH {MARKET} SELECT source_platform, count(*) AS open_postings, count(DISTINCT company) AS companies FROM market WHERE is_open AND source_platform <> 'Pasted JD' GROUP BY source_platform")
def _(s: Source):
    return snapshot.sources(market(s), s.as_of())


def _exported(s: Source, log, root: str, version: str) -> None:
    """The whole snapshot behind the gate, which is asked before anything is made, and by the export again."""
    from snaplake.plans.quality_gate import gate_state, require_passed
    gate = gate_state(log, F.desc("checked_at"))
    require_passed(gate)
    # nine sets are cut from these three, which are made once; the sets of skills look at each posting once, so a skill may come again
    demand = scoring.market_demand(s, scoring.asked(s)).withColumn("job_key", F.col("job_key").cast("string"))
    view, demand = stored(market(s), "market"), stored(demand, "demand")
    days = stored(lc.daily_activity(s["snap"], view), "days")
    snapshot.export(snapshot.results(view, demand, days, log, s.as_of(), {"tools": ["rod"], "parts": ["hot", "gear"]}), gate, root, version)


def _next_run(log, passed: bool):
    """The log with one more run of each check, a day after its newest row."""
    newest = log.groupBy("check_name").agg((F.max("checked_at") + F.expr("INTERVAL 1 DAY")).alias("checked_at"), F.max("seq").alias("seq"), F.lit(0.0).alias("value"), F.lit(passed).alias("passed"), F.bool_or("blocking").alias("blocking"))
    return log.unionByName(newest)


@query("snapshot_export", f"WITH {MARKET} SELECT 'cities' AS part, city AS name, count(*) AS n FROM market WHERE is_open GROUP BY city UNION ALL SELECT 'sources', source_platform, count(*) FROM market WHERE is_open AND source_platform <> 'Pasted JD' GROUP BY source_platform")
def _(s: Source):
    """A log whose newest run passes, though earlier ones did not: two of the nine sets, read back through their pointer."""
    from snaplake.operators.upsert import published
    root = new_path(s.spark, "snapshot")
    _exported(s, _next_run(s["checks"], True), root, "v1")
    part = lambda p, name: published(s.spark, root, part=p).select(F.lit(p).alias("part"), F.col(name).alias("name"), F.col("open_postings").alias("n"))
    return part("cities", "city").unionByName(part("sources", "source_platform"))


@query("snapshot_refused", "SELECT count(*) AS failed_blocking, 'v1' AS version, 1 AS published FROM (SELECT check_name FROM {checks} GROUP BY check_name HAVING bool_or(blocking))")
def _(s: Source):
    """After a version is out, the newest run of every check fails: nothing is published, and readers keep what they have."""
    from snaplake.operators.upsert import last_published
    from snaplake.plans.quality_gate import gate_state
    root, good, bad = new_path(s.spark, "refused"), _next_run(s["checks"], True), _next_run(s["checks"], False)
    snapshot.export({"quality": gate_state(good, F.desc("checked_at"))}, gate_state(good, F.desc("checked_at")), root, "v1")
    try:
        _exported(s, bad, root, "v2")
    except RuntimeError:
        last = last_published(s.spark, root)
        return gate_state(bad, F.desc("checked_at")).select("failed_blocking", F.lit(last["version"]).alias("version"), F.lit(last["seq"]).cast("int").alias("published"))
    raise AssertionError("published in spite of failed checks")


ROLES = "job_key, company, title, city, round(fit_score) AS fit_score, recommendation, url"


@query("top_roles", f"WITH {MARKET} SELECT {ROLES} FROM market WHERE is_open AND recommendation <> 'SKIP' AND days_since_posted <= 30 ORDER BY market.fit_score DESC, first_seen DESC, job_key LIMIT 15")
def _(s: Source):
    return snapshot.roles(market(s))


@query("apply_list", f"""WITH {MARKET} SELECT job_key, company, title, city, round(fit_score) AS fit_score, CASE recommendation WHEN 'APPLY' THEN 'Apply' ELSE 'Worth a try' END AS fit_band, array_to_string(matched_skills[1:6], ', ') AS highlight,
  years_required, CAST(posted_date AS VARCHAR) AS posted_date, days_since_posted, url FROM market WHERE is_open AND recommendation IN ('APPLY', 'STRETCH') AND days_since_posted <= 30""")
def _(s: Source):
    rows = market(s).where("is_open AND recommendation IN ('APPLY', 'STRETCH') AND days_since_posted <= 30").orderBy("recommendation", F.desc("fit_score"), F.desc("first_seen"), "job_key")
    band = F.when(F.col("recommendation") == "APPLY", "Apply").otherwise("Worth a try")
    return text_dates(rows.select("job_key", "company", "title", "city", F.round("fit_score").alias("fit_score"), band.alias("fit_band"), F.array_join(F.slice("matched_skills", 1, 6), ", ").alias("highlight"), "years_required", "posted_date", "days_since_posted", "url"))


@query("ready_list", f"WITH {MARKET} SELECT job_key, company, city, fit_score, applied.n AS applications FROM market JOIN (SELECT concat('k', user_id, '-', event_id % 5) AS job_key, count(*) AS n FROM {{events}} WHERE event_type = 'purchase' GROUP BY 1) applied USING (job_key) WHERE is_open AND is_enriched")
def _(s: Source):
    applied = s["events"].where("event_type = 'purchase'").groupBy(F.concat(F.lit("k"), "user_id", F.lit("-"), F.col("event_id") % 5).alias("job_key")).agg(F.count("*").alias("applications"))
    return market(s).where("is_open AND is_enriched").join(applied, "job_key").select("job_key", "company", "city", "fit_score", "applications")


@query("largest_group", f"WITH {ALL} SELECT company FROM good WHERE is_open GROUP BY company ORDER BY count(*) DESC, company LIMIT 1")
def _(s: Source):
    return mk.largest_group(lc.clean(lc.postings(s["snap"])), "company", F.col("is_open"))


@query("fit_summary", f"WITH {MARKET} SELECT recommendation, count(*) AS postings, {mean_1("fit_score")} AS avg_score, max(fit_score) AS best FROM market WHERE is_enriched GROUP BY recommendation")
def _(s: Source):
    return market(s).where("is_enriched").groupBy("recommendation").agg(F.count("*").alias("postings"), average("fit_score", 1).alias("avg_score"), F.max("fit_score").alias("best"))


@query("mv_skill_demand", f"WITH {scoring.DEMAND} SELECT skill, skill_status, count(DISTINCT job_key) AS postings_asking, count(DISTINCT job_key) FILTER (requirement = 'must') AS must_have_postings FROM demand GROUP BY ALL")
def _(s: Source):
    return metrics.skill_demand(scoring.market_demand(s)).query(["skill", "skill_status"], ["postings_asking", "must_have_postings"])


@query("mv_skill_by_domain", f"WITH {scoring.DEMAND} SELECT skill, domain, count(DISTINCT job_key) AS postings_asking, count(DISTINCT job_key) FILTER (requirement = 'must') AS must_have_postings FROM demand WHERE is_open GROUP BY ALL")
def _(s: Source):
    return metrics.skill_demand(scoring.market_demand(s)).query(["skill", "domain"], ["postings_asking", "must_have_postings"], "is_open")


@query("snapshot_skills", f"WITH {scoring.DEMAND} SELECT skill, skill_status, count(DISTINCT job_key) FILTER (requirement = 'must') AS must_have_postings FROM demand WHERE is_open GROUP BY ALL ORDER BY 3 DESC, 1 LIMIT 20")
def _(s: Source):
    return snapshot.skills(scoring.market_demand(s))


@query("skill_flags", f"""WITH {scoring.DEMAND}, a AS (SELECT job_key, max(CASE WHEN skill = 'rod' THEN 1.0 ELSE 0.0 END) AS tools, max(CASE WHEN skill IN ('hot', 'gear') THEN 1.0 ELSE 0.0 END) AS parts FROM demand GROUP BY job_key)
SELECT CAST(avg(coalesce(tools, 0)) AS DOUBLE) AS tools_share, CAST(avg(coalesce(parts, 0)) AS DOUBLE) AS parts_share FROM {{reqmeta}} m LEFT JOIN a USING (job_key) WHERE is_open""")
def _(s: Source):
    rows = s["reqmeta"].withColumn("is_enriched", F.lit(True))
    return snapshot.skill_flags(rows, scoring.market_demand(s), {"tools": ["rod"], "parts": ["hot", "gear"]})


@query("top20_members", f"WITH {scoring.DEMAND}, t AS (SELECT skill FROM demand WHERE requirement = 'must' GROUP BY skill ORDER BY count(DISTINCT job_key) DESC, skill LIMIT 20) SELECT job_key, skill, skill_status FROM demand WHERE requirement = 'must' AND skill IN (SELECT skill FROM t)")
def _(s: Source):
    rows = scoring.market_demand(s).where("requirement = 'must'")
    status = F.when(F.col("in_profile"), "Have it").when(F.col("on_learning_list"), "Learning").otherwise("Gap")
    return snapshot.top_members(rows, "skill", "job_key", 20).select("job_key", "skill", status.alias("skill_status"))
