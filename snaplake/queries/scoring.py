"""Skills, demand, fit and actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from snaplake.functions.text import canonical_terms
from snaplake.operators import score as sc
from snaplake.queries.registry import Source, query, text_dates
from snaplake.storage import pieces

ADJECTIVES = ["cold", "old", "blue", "new", "large", "small", "red", "hot"]
NOUNS = ["rod", "plate", "widget", "ring", "bolt", "gear"]  # two nouns of the tables are unknown terms
PROFILE = sc.Profile(have=["red", "blue", "bolt", "gear", "small"], learning=["hot", "ring"], shown=["red", "bolt"], equivalent={"widget": ["bolt"], "old": ["new"]}, years=5, places=["nation_1", "nation_2"], domains=["building", "machin"], vocabulary=[*ADJECTIVES, *NOUNS])


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


HAVE, LEARN, SHOWN, KNOWN = _in([*PROFILE.have, "widget"]), _in(PROFILE.learning), _in([*PROFILE.shown, "widget"]), _in(PROFILE.vocabulary)
ROWS = "rr AS (SELECT DISTINCT job_key, requirement, skill FROM (SELECT job_key, requirement, unnest([s1, s2]) AS skill FROM {req}))"
DEMAND = f"""{ROWS}, demand AS (SELECT rr.job_key, requirement, skill, m.domain, m.location, m.is_open, skill IN {HAVE} AS in_profile, skill IN {LEARN} AS on_learning_list, skill IN {KNOWN} AS known_skill,
  CASE WHEN skill IN {HAVE} THEN 'Have it' WHEN skill IN {LEARN} THEN 'Learning' ELSE 'Gap' END AS skill_status FROM rr JOIN {{reqmeta}} m USING (job_key))"""


def _pieces(s: Source) -> int:
    """Partitions for what is dealt by posting."""
    return pieces(s["lineitem"], s["orders"])


def asked(s: Source):
    """Skills of each posting and requirement as its lines name them, so a skill may come again; dealt by posting once, and all that follows keeps to it."""
    dealt = s["req"].select("job_key", "requirement", "s1", "s2").repartition(_pieces(s), "job_key")
    return dealt.select("job_key", "requirement", F.explode(F.array("s1", "s2")).alias("skill"))


def skills(s: Source):
    """Distinct skills of each posting and requirement."""
    return asked(s).distinct()


def market_demand(s: Source, named=None):
    rows = sc.demand_rows(skills(s) if named is None else named, PROFILE)
    return rows.join(s["reqmeta"].select("job_key", "domain", "location", "is_open"), "job_key")


@query("requirement_rows", f"WITH {ROWS} SELECT * FROM rr")
def _(s: Source):
    lists = s["req"].groupBy("job_key").agg(*[F.array_distinct(F.flatten(F.collect_list(F.when(F.col("requirement") == k, F.array("s1", "s2"))))).alias(k) for k in ("must", "nice")])
    return sc.requirement_rows(lists)


@query("coverage", f"WITH {ROWS} SELECT job_key, skill, requirement, skill IN {HAVE} AS covered FROM rr")
def _(s: Source):
    return skills(s).select("job_key", "skill", "requirement", sc.covered("skill", PROFILE.have, PROFILE.equivalent).alias("covered"))


@query("skill_demand", f"WITH {ROWS} SELECT job_key, skill, requirement, skill IN {HAVE} AS in_profile, skill IN {LEARN} AS on_learning_list, skill IN {KNOWN} AS known_skill FROM rr")
def _(s: Source):
    return sc.demand_rows(skills(s), PROFILE)


COUNTS = f"{DEMAND}, counts AS (SELECT skill, count(DISTINCT job_key) FILTER (requirement = 'must') AS must_postings, count(DISTINCT job_key) AS all_postings FROM demand WHERE is_open AND known_skill GROUP BY skill)"


def _counts(s: Source):
    return sc.skill_counts(market_demand(s).where("is_open AND known_skill"))


@query("skill_counts", f"WITH {COUNTS} SELECT * FROM counts")
def _(s: Source):
    return _counts(s)


@query("unknown_terms", f"WITH {DEMAND} SELECT skill, count(DISTINCT job_key) AS postings, count(DISTINCT job_key) FILTER (requirement = 'must') AS required_by FROM demand WHERE is_open AND NOT known_skill GROUP BY skill ORDER BY 2 DESC, 1 LIMIT 30")
def _(s: Source):
    rows = sc.skill_counts(market_demand(s).where("is_open AND NOT known_skill"))
    return rows.select("skill", F.col("all_postings").alias("postings"), F.col("must_postings").alias("required_by")).orderBy(F.desc("postings"), "skill").limit(30)


@query("actions", f"""WITH {COUNTS}, shown AS (SELECT skill FROM counts WHERE skill IN {HAVE} AND skill IN {SHOWN} ORDER BY must_postings DESC, all_postings DESC, skill LIMIT 5),
p AS (SELECT *, CASE WHEN skill IN {HAVE} AND skill NOT IN {SHOWN} THEN 2 WHEN skill IN {HAVE} AND skill IN (SELECT skill FROM shown) THEN 1 WHEN skill IN {HAVE} THEN 5 WHEN skill IN {LEARN} THEN 3 WHEN must_postings >= 3 THEN 4 ELSE 6 END AS priority FROM counts)
SELECT skill, must_postings, all_postings, CASE WHEN skill IN {HAVE} THEN 'Have it' WHEN skill IN {LEARN} THEN 'Learning' ELSE 'Gap' END AS status, CAST(priority AS INTEGER) AS priority, priority IN (2) AS add_it FROM p""")
def _(s: Source):
    rows = sc.actions(_counts(s), PROFILE)
    return rows.select("skill", "must_postings", "all_postings", "status", "priority", (F.col("action") == sc.ACTIONS[2]).alias("add_it"))


@query("lead_set", f"WITH {COUNTS} SELECT skill, must_postings, all_postings, row_number() OVER (ORDER BY must_postings DESC, all_postings DESC, skill) <= 5 AS lead FROM counts")
def _(s: Source):
    return sc.leads(_counts(s))


_PLACES = " OR ".join(f"contains(place, '{p}')" for p in PROFILE.places)
_DOMAINS = " OR ".join(f"contains(lower(domain), '{d}')" for d in PROFILE.domains)


# phrases to known names: every first word is one, so the words that are known are the names
FOUND = f"rr AS (SELECT job_key, requirement, skill, min(line * 10 + i) AS place FROM (SELECT job_key, requirement, line, unnest([s1, s2]) AS skill, unnest([0, 1]) AS i FROM {{req}}) WHERE skill IN {KNOWN} GROUP BY job_key, requirement, skill)"


@query("fit_score", f"""WITH {FOUND}, n AS (SELECT job_key, count(*) FILTER (requirement = 'must') AS ma, count(*) FILTER (requirement = 'must' AND skill IN {HAVE}) AS mo, count(*) FILTER (requirement = 'nice') AS na, count(*) FILTER (requirement = 'nice' AND skill IN {HAVE}) AS no,
  coalesce(string_agg(skill, '|' ORDER BY requirement, place) FILTER (skill IN {HAVE}), '') AS matched_skills, coalesce(string_agg(skill, '|' ORDER BY place) FILTER (requirement = 'must' AND skill NOT IN {HAVE}), '') AS missing_skills,
  coalesce(string_agg(skill, '|' ORDER BY place) FILTER (requirement = 'must' AND skill NOT IN {HAVE} AND skill IN {LEARN}), '') AS learning_gaps FROM rr GROUP BY job_key),
m AS (SELECT n.*, domain, trim(lower(coalesce(location, ''))) AS place, coalesce(mo / nullif(ma, 0), no / nullif(na, 0), 0.5) AS must_part,
  CASE WHEN years_min IS NULL OR years_min - 5 <= 0 THEN 1.0 WHEN years_min - 5 <= 1 THEN 0.6 WHEN years_min - 5 <= 2 THEN 0.3 ELSE 0.0 END AS years_part FROM n JOIN {{reqmeta}} USING (job_key)),
q AS (SELECT *, coalesce(no / nullif(na, 0), must_part) AS nice_part, CASE WHEN place = '' THEN 0.5 WHEN {_PLACES} THEN 1.0 ELSE 0.0 END AS location_part, CASE WHEN {_DOMAINS} THEN 1.0 ELSE 0.0 END AS domain_part FROM m),
z AS (SELECT *, CAST(round(CAST(100.0::DOUBLE * (0.55::DOUBLE * must_part + 0.15::DOUBLE * nice_part + 0.15::DOUBLE * years_part::DOUBLE + 0.1::DOUBLE * location_part::DOUBLE + 0.05::DOUBLE * domain_part::DOUBLE) AS DECIMAL(18,9)), 1) AS DOUBLE) AS fit_score FROM q)
SELECT job_key, fit_score, CASE WHEN fit_score >= 70 AND years_part >= 0.6 AND location_part > 0 THEN 'APPLY' WHEN fit_score >= 50 THEN 'STRETCH' ELSE 'SKIP' END AS recommendation,
  CAST(round(CAST(must_part AS DECIMAL(18,9)), 3) AS DOUBLE) AS must_coverage, CAST(round(CAST(nice_part AS DECIMAL(18,9)), 3) AS DOUBLE) AS nice_coverage, CAST(years_part AS DOUBLE) AS years_part, CAST(location_part AS DOUBLE) AS location_part, CAST(domain_part AS DOUBLE) AS domain_part, matched_skills, missing_skills, learning_gaps FROM z""")
def _(s: Source):
    phrases = s["req"].select("job_key", "requirement", F.col("line").alias("place"), F.upper("phrase").alias("phrase"))
    return text_dates(sc.fit(sc.canonical_skills(phrases, PROFILE.vocabulary, {}, _pieces(s)), s["reqmeta"].withColumn("work_mode", F.lit("")), PROFILE))


@query("phrase_canon", f"""SELECT p_partkey, p_name, CASE WHEN len(list_filter(string_split(p_name, ' '), lambda w: w IN {KNOWN})) = 0 THEN p_name ELSE array_to_string(list_filter(string_split(p_name, ' '), lambda w: w IN {KNOWN}), '|') END AS terms FROM {{part}}""")
def _(s: Source):
    return text_dates(canonical_terms(s["part"].select("p_partkey", "p_name"), "p_name", PROFILE.vocabulary, {}).select("p_partkey", "p_name", "terms"))
