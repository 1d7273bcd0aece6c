"""Public result sets: market data only.  The functions take market frames and nothing private."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplake.operators.upsert import publish_set
from snaplake.plans import metrics
from snaplake.plans.quality_gate import gate_state, require_passed


def top(rows: DataFrame, k: int | None, *order: Column | str) -> DataFrame:
    """Ranked rows, all or the first ``k``; orders end in a key, so ties are decided."""
    ranked = rows.orderBy(*order)
    return ranked.limit(k) if k else ranked


def kpis(market: DataFrame, as_of: Column) -> DataFrame:
    view = metrics.job_market(market, as_of)
    numbers = view.query([], ["open_postings", "companies", "median_years_required", "strong_fit_rate", "enrichment_coverage", "largest_company_share"], "is_open")
    facts = market.agg(F.max("last_seen").alias("as_of"), F.max(F.when(F.col("from_largest_company"), F.col("company"))).alias("largest_company"))
    return numbers.crossJoin(F.broadcast(facts))


def cities(market: DataFrame, as_of: Column) -> DataFrame:
    return top(metrics.job_market(market, as_of).query(["city"], ["open_postings"], "is_open"), None, F.desc("open_postings"), "city")


def domains(market: DataFrame, as_of: Column, k: int = 10) -> DataFrame:
    return top(metrics.job_market(market, as_of).query(["domain"], ["open_postings"], "is_open AND is_enriched AND domain <> 'Not stated'"), k, F.desc("open_postings"), "domain")


def sources(market: DataFrame, as_of: Column) -> DataFrame:
    return top(metrics.job_market(market, as_of).query(["source_platform"], ["open_postings", "companies"], "is_open AND source_platform <> 'Pasted JD'"), None, F.desc("open_postings"), "source_platform")


def daily(days: DataFrame, as_of: Column, back: int = 120) -> DataFrame:
    recent = days.where(F.col("snapshot_day") >= F.date_sub(as_of, back))
    return metrics.market_daily(recent).query(["day"], ["avg_open_postings", "new_postings"])


def skills(demand: DataFrame, k: int = 20) -> DataFrame:
    return top(metrics.skill_demand(demand).query(["skill", "skill_status"], ["must_have_postings"], "is_open"), k, F.desc("must_have_postings"), "skill")


def skill_flags(market: DataFrame, demand: DataFrame, groups: Mapping[str, list[str]]) -> DataFrame:
    """Share of enriched open postings that ask for any skill of a group; postings without demand count as not asking."""
    asked = demand.groupBy("job_key").agg(*[F.max(F.col("skill").isin(s)).cast("double").alias(g) for g, s in groups.items()])
    rows = market.where("is_open AND is_enriched").select("job_key").join(asked, "job_key", "left")
    return rows.agg(*[F.avg(F.coalesce(g, F.lit(0.0))).alias(f"{g}_share") for g in groups])


def roles(market: DataFrame, k: int = 15) -> DataFrame:
    fresh = market.where("is_open AND recommendation <> 'SKIP' AND days_since_posted <= 30")
    return top(fresh, k, F.desc("fit_score"), F.desc("first_seen"), "job_key").select("job_key", "company", "title", "city", F.round("fit_score").alias("fit_score"), "recommendation", "url")


def top_members(rows: DataFrame, member: str, key: str, k: int) -> DataFrame:
    """Rows of the ``k`` members that most distinct keys have."""
    best = rows.groupBy(member).agg(F.count_distinct(key).alias("n")).orderBy(F.desc("n"), member).limit(k).select(member)
    return rows.join(best, member, "left_semi")


def results(market: DataFrame, demand: DataFrame, days: DataFrame, checks: DataFrame, as_of: Column, groups: Mapping[str, list[str]]) -> dict[str, DataFrame]:
    """All public result sets by name.  ``checks`` is the quality log; nothing else about the run or the profile goes in."""
    state = gate_state(checks, F.desc("checked_at"))
    return {
        "quality": state, "kpis": kpis(market, as_of), "skill_flags": skill_flags(market, demand, groups), "daily": daily(days, as_of), "skills": skills(demand),
        "cities": cities(market, as_of), "domains": domains(market, as_of), "roles": roles(market), "sources": sources(market, as_of),
    }


def export(results: Mapping[str, DataFrame], gate: DataFrame, root: str, version: str) -> dict[str, str]:
    """Write the named results as one JSON version and point to it, unless the gate is shut."""
    require_passed(gate)
    return publish_set(results, root, version, "json")


def first_k(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)
