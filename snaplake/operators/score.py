"""Fit of postings to a profile, demand for skills, and what to do about it: column arithmetic throughout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.functions.text import canonical_terms

# Weights and thresholds of the score.
WEIGHTS = {"must": 0.55, "nice": 0.15, "years": 0.15, "location": 0.10, "domain": 0.05}
APPLY, STRETCH, MIN_YEARS = 70, 50, 0.6
LEAD, CONSIDER = 5, 3
ACTIONS = {
    1: "Lead with it: headline or first in Core Skills",
    2: "Add to resume: you have it but it isn't shown",
    3: "Learning: add once you have project proof",
    4: "Consider learning: often required, not in your profile",
    5: "Keep: already on your resume",
    6: "Low priority",
}


@dataclass(frozen=True)
class Profile:
    have: Sequence[str]
    learning: Sequence[str]
    shown: Sequence[str]
    equivalent: Mapping[str, Sequence[str]]
    years: float
    places: Sequence[str]
    domains: Sequence[str]
    vocabulary: Sequence[str] = field(default_factory=list)


def covered(skill: str | Column, have: Sequence[str], equivalent: Mapping[str, Sequence[str]]) -> Column:
    """Whether a skill, or one that stands for it, is there.  The answer is worked out per vocabulary, not per row."""
    owned = set(have)
    names = sorted(owned | {s for s, by in equivalent.items() if owned & set(by)})
    c = F.col(skill) if isinstance(skill, str) else skill
    return c.isin(names)


def requirement_rows(postings: DataFrame, must: str = "must", nice: str = "nice") -> DataFrame:
    """``job_key, requirement, skill`` from two arrays; a skill in both gives two rows."""
    tagged = F.array(F.struct(F.lit("must").alias("requirement"), F.col(must).alias("skills")), F.struct(F.lit("nice").alias("requirement"), F.col(nice).alias("skills")))
    return postings.select("job_key", F.explode(tagged).alias("t")).select("job_key", "t.requirement", F.explode("t.skills").alias("skill"))


def years_part(stated: str, years: float) -> Column:
    gap = F.col(stated) - F.lit(float(years))
    return F.when(F.col(stated).isNull() | F.isnan(stated) | (gap <= 0), 1.0).when(gap <= 1, 0.6).when(gap <= 2, 0.3).otherwise(0.0)


def contains_any(c: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(c, w)) if words else F.lit(False)


def rounded(x: Column, places: int) -> Column:
    """Half up on the decimal value, so that thresholds are the same wherever this runs."""
    return F.round(x.cast("decimal(18,9)"), places).cast("double")


def average(x: str, places: int) -> Column:
    """The mean, half up; sums of decimals don't depend on their order."""
    return F.round(F.avg(F.col(x).cast("decimal(18,6)")), places).cast("double")


def fit(skills: DataFrame, meta: DataFrame, profile: Profile) -> DataFrame:
    """Score, recommendation, parts and skill lists of each posting of ``skills`` (``job_key, requirement, skill, place``, distinct by the first three).

    Lists keep the order of ``place``, must before nice; a covered skill of both is matched twice.  ``meta``: ``job_key, years_min, location,
    work_mode, domain``.  One grouping by posting; no row leaves the JVM.
    """
    is_must, ok = F.col("requirement") == "must", covered("skill", profile.have, profile.equivalent)
    in_order = lambda which: F.transform(F.sort_array(F.collect_list(F.when(which, F.struct(~is_must, "place", "skill")))), lambda s: s["skill"])
    n = skills.groupBy("job_key").agg(
        F.count_if(is_must).alias("must_all"),
        F.count_if(is_must & ok).alias("must_ok"),
        F.count_if(~is_must).alias("nice_all"),
        F.count_if(~is_must & ok).alias("nice_ok"),
        in_order(ok).alias("matched"),
        in_order(is_must & ~ok).alias("missing"),
    )
    rows = n.join(meta, "job_key")
    part = lambda kind: F.col(f"{kind}_ok") / F.nullif(F.col(f"{kind}_all"), F.lit(0))
    where = F.trim(F.lower(F.concat(F.coalesce("location", F.lit("")), F.lit(" "), F.coalesce("work_mode", F.lit("")))))
    rows = rows.withColumns({"must_part": F.coalesce(part("must"), part("nice"), F.lit(0.5)), "years_part": years_part("years_min", profile.years)})
    rows = rows.withColumns({
        "nice_part": F.coalesce(part("nice"), F.col("must_part")),
        "location_part": F.when(where == "", 0.5).when(contains_any(where, profile.places), 1.0).otherwise(0.0),
        "domain_part": F.when(contains_any(F.lower(F.coalesce("domain", F.lit(""))), profile.domains), 1.0).otherwise(0.0),
    })
    w = WEIGHTS
    total = F.lit(100.0) * (F.lit(w["must"]) * F.col("must_part") + F.lit(w["nice"]) * F.col("nice_part") + F.lit(w["years"]) * F.col("years_part") + F.lit(w["location"]) * F.col("location_part") + F.lit(w["domain"]) * F.col("domain_part"))
    rows = rows.withColumn("fit_score", rounded(total, 1))
    verdict = F.when((F.col("fit_score") >= APPLY) & (F.col("years_part") >= MIN_YEARS) & (F.col("location_part") > 0), "APPLY").when(F.col("fit_score") >= STRETCH, "STRETCH").otherwise("SKIP")
    gaps = F.array_intersect("missing", F.array(*map(F.lit, profile.learning)))
    return rows.select("job_key", "fit_score", verdict.alias("recommendation"), rounded(F.col("must_part"), 3).alias("must_coverage"), rounded(F.col("nice_part"), 3).alias("nice_coverage"), "years_part", "location_part", "domain_part", F.col("matched").alias("matched_skills"), F.col("missing").alias("missing_skills"), gaps.alias("learning_gaps"))


def canonical_skills(phrases: DataFrame, vocabulary: Sequence[str], aliases: Mapping[str, str], parts: int | None = None) -> DataFrame:
    """``job_key, requirement, skill, place`` from rows ``job_key, requirement, place, phrase``: the known names in each posting's phrases, each once, where first seen.

    With ``parts`` phrases are dealt by posting into so many partitions before names are told apart, and :func:`fit` goes on there.
    """
    named = canonical_terms(phrases, "phrase", vocabulary, aliases).select("job_key", "requirement", "place", "terms")
    named = named.repartition(parts, "job_key") if parts else named
    found = named.select("job_key", "requirement", "place", F.posexplode("terms").alias("within", "skill"))
    return found.groupBy("job_key", "requirement", "skill").agg(F.min(F.struct("place", "within")).alias("place"))


def demand_rows(skills: DataFrame, profile: Profile) -> DataFrame:
    """Demand with what the profile says of each skill."""
    return skills.select("job_key", "skill", "requirement", covered("skill", profile.have, profile.equivalent).alias("in_profile"), F.col("skill").isin(list(profile.learning)).alias("on_learning_list"), F.col("skill").isin(list(profile.vocabulary)).alias("known_skill"))


def skill_counts(demand: DataFrame) -> DataFrame:
    """Distinct postings that require a skill, and that ask for it at all."""
    once = demand.groupBy("skill", "job_key").agg(F.max(F.col("requirement") == "must").alias("must"))
    return once.groupBy("skill").agg(F.count_if("must").alias("must_postings"), F.count("*").alias("all_postings"))


def actions(counts: DataFrame, profile: Profile) -> DataFrame:
    """An action for each skill, the most useful first.  ``counts`` has a row per skill, so ranking the shown ones is a small job."""
    have, shown = covered("skill", profile.have, profile.equivalent), covered("skill", profile.shown, profile.equivalent)
    ranked = counts.where(have & shown).orderBy(F.desc("must_postings"), F.desc("all_postings"), "skill").limit(LEAD).select(F.col("skill").alias("lead"))
    rows = counts.join(F.broadcast(ranked), F.col("skill") == F.col("lead"), "left")
    priority = (
        F.when(have & ~shown, 2)
        .when(have & F.col("lead").isNotNull(), 1)
        .when(have, 5)
        .when(F.col("skill").isin(list(profile.learning)), 3)
        .when(F.col("must_postings") >= CONSIDER, 4)
        .otherwise(6)
    )
    status = F.when(have, "Have it").when(F.col("skill").isin(list(profile.learning)), "Learning").otherwise("Gap")
    rows = rows.withColumn("priority", priority)
    label = F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), F.col("priority"))
    rows = rows.select("skill", "must_postings", "all_postings", status.alias("status"), label.alias("action"), "priority")
    return rows.orderBy("priority", F.desc("must_postings"), F.desc("all_postings"), "skill")


def leads(counts: DataFrame, k: int = LEAD) -> DataFrame:
    """``counts`` with ``lead``: whether a skill is among the first ``k``, which alone are sent around."""
    first = counts.orderBy(F.desc("must_postings"), F.desc("all_postings"), "skill").limit(k).select(F.col("skill").alias("__skill"))
    return counts.join(F.broadcast(first), F.col("skill") == F.col("__skill"), "left").withColumn("lead", F.col("__skill").isNotNull()).drop("__skill")
