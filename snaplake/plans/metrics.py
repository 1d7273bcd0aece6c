"""Metrics defined once as columns and evaluated at any grain."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.operators import rules
from snaplake.operators.score import average


@dataclass(frozen=True)
class MetricView:
    """Dimensions and measures over a source.

    ``query`` groups by some dimensions and evaluates some measures in one aggregate.  Only names that are
    defined may be used, in ``where`` as well, so a metric cannot be bent by a column that it does not publish.
    Where the source has one row per ``key``, counts of distinct keys are sums of flags, which combine before the shuffle.
    Where it has several, ``once`` (the key, and what is to be known of each) makes one row per key of every group first, and the measures look at these:
    rows dealt by that key are not shuffled again, and several distinct counts need no copy of a row each.
    """

    source: DataFrame
    dimensions: Mapping[str, Column]
    measures: Mapping[str, Column]
    comments: Mapping[str, str] = field(default_factory=dict)
    once: tuple[str, Mapping[str, Column]] | None = None

    def query(self, dims: Sequence[str] = (), measures: Sequence[str] = (), where: str | None = None) -> DataFrame:
        for name in dims:
            if name not in self.dimensions:
                raise KeyError(f"no dimension {name}")
        for name in measures:
            if name not in self.measures:
                raise KeyError(f"no measure {name}")
        rows = self.source
        if where:
            shown = rows.select(*[c.alias(n) for n, c in self.dimensions.items()])
            rows.sparkSession.createDataFrame([], shown.schema).where(where)  # fails on a name that is not a dimension
            rows = rows.withColumns(dict(self.dimensions)).where(where)
        keys = [self.dimensions[d].alias(d) for d in dims]
        if self.once:
            key, known = self.once
            rows = rows.groupBy(*keys, F.col(key).alias("__key")).agg(*[c.alias(n) for n, c in known.items()])
            keys = [F.col(d) for d in dims]
        return rows.groupBy(*keys).agg(*[self.measures[m].alias(m) for m in measures])


def count_where(condition: Column | None = None) -> Column:
    """Distinct keys where a condition holds, for a source with a row per key."""
    return F.count("*") if condition is None else F.count_if(condition)


def distinct_where(column: str, condition: Column | None = None) -> Column:
    c = F.col(column)
    return F.count_distinct(c if condition is None else F.when(condition, c))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where there is nothing to divide by."""
    return a / F.nullif(b, F.lit(0))


def job_market(market: DataFrame, as_of: Column) -> MetricView:
    """Postings, fit and experience over a market view (a row per posting)."""
    c = F.col
    dims = {n: c(n) for n in ("company", *STATED)} | {"first_seen_week": F.date_trunc("WEEK", c("first_seen")).cast("date"), "source_platform": rules.labelled("source", rules.PLATFORMS)}
    return MetricView(market, dims, _market_measures(count_where, average("fit_score", 1), F.max("fit_score"), F.percentile("years_required", 0.5), *_ages(as_of)))


#: Dimensions that a market view has as columns.
STATED = ("city", "domain", "seniority", "work_mode", "recommendation", "is_open", "is_enriched", "from_largest_company", "posting_age", "title")
#: What measures look at, so that every cube has it.
_LOOKED_AT = ("company", "source", "recommendation", "is_open", "is_enriched", "from_largest_company", "years_required")


def _ages(as_of: Column) -> tuple[Column, Column]:
    """Whether a posting is new this week, and whether it is an older one."""
    return F.col("first_seen") >= F.date_sub(as_of, 7), F.col("days_since_posted") > 30


def _market_measures(count: Callable[..., Column], mean_fit: Column, best_fit: Column, median_years: Column, is_new: Column, is_older: Column) -> dict[str, Column]:
    """The measures, given how postings are counted and how states are merged."""
    c = F.col
    applies, enriched, largest = c("recommendation") == "APPLY", c("is_enriched"), c("from_largest_company")
    return {
        "postings": count(),
        "open_postings": count(c("is_open")),
        "enriched_postings": count(enriched),
        "enrichment_coverage": ratio(count(enriched), count()),
        "strong_fit_postings": count(applies),
        "stretch_postings": count(c("recommendation") == "STRETCH"),
        "companies_with_strong_fit": distinct_where("company", applies),
        "new_this_week": count(is_new),
        "best_fit_score": best_fit,
        "older_open_postings": count(c("is_open") & is_older),
        "strong_fit_rate": ratio(count(applies), count(enriched)),
        "avg_fit_score": mean_fit,
        "median_years_required": median_years,
        "companies": distinct_where("company"),
        "source_platforms": distinct_where("source", c("source") != "manual"),
        "largest_company_share": ratio(count(largest), count()),
    }


def market_cube(market: DataFrame, as_of: Column, dims: Sequence[str] = (*STATED, "first_seen_week")) -> DataFrame:
    """One aggregate of a market view at the grain of ``dims``, from which all measures roll up.

    Companies, platforms and stated years belong to the grain, so distinct counts and the median need no set and no sketch: they are exact at any coarser grain.
    Rows are at most the postings; leave ``title`` out where no panel shows it.
    """
    is_new, is_older = _ages(as_of)
    week = F.date_trunc("WEEK", F.col("first_seen")).cast("date").alias("first_seen_week")
    grain = [week if d == "first_seen_week" else F.col(d) for d in dict.fromkeys((*_LOOKED_AT, *dims))]
    fit = F.col("fit_score").cast("decimal(18,6)")
    return market.groupBy(*grain, is_new.alias("is_new"), is_older.alias("is_older")).agg(F.count("*").alias("rows"), F.sum(fit).alias("fit_sum"), F.count("fit_score").alias("fit_count"), F.max("fit_score").alias("fit_max"))


def market_from_cube(cube: DataFrame) -> MetricView:
    """The measures of :func:`job_market` from a :func:`market_cube`, which is read in place of the market."""
    c = F.col
    count = lambda condition=None: F.coalesce(F.sum(c("rows") if condition is None else F.when(condition, c("rows"))), F.lit(0))
    mean = F.round(F.sum("fit_sum").cast("decimal(26,6)") / F.nullif(F.sum("fit_count").cast("decimal(12,0)"), F.lit(0).cast("decimal(12,0)")), 1).cast("double")
    dims = {d: c(d) for d in ("company", *STATED, "first_seen_week") if d in cube.columns} | {"source_platform": rules.labelled("source", rules.PLATFORMS)}
    return MetricView(cube, dims, _market_measures(count, mean, F.max("fit_max"), F.percentile("years_required", 0.5, c("rows")), c("is_new"), c("is_older")))


def long_panels(view: MetricView, panels: Mapping[str, tuple[Sequence[str], Sequence[str], str | None]]) -> DataFrame:
    """``panel, grain, measure, value`` of all ``panels`` (dimensions, measures, filter) of a view: one table for a page of them.

    ``grain`` joins the values of the dimensions by ``|``, with ``-`` for null.
    """
    out = None
    for name, (dims, measures, where) in panels.items():
        rows = view.query(dims, measures, where)
        grain = F.concat_ws("|", *[F.coalesce(F.col(d).cast("string"), F.lit("-")) for d in dims])
        values = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
        one = rows.select(F.lit(name).alias("panel"), grain.alias("grain"), F.inline(values))
        out = one if out is None else out.unionByName(one)
    return out


def skill_demand(demand: DataFrame) -> MetricView:
    """Skills asked for; a posting may ask for a skill twice, so keys are counted distinct."""
    c = F.col
    status = F.when(c("in_profile"), "Have it").when(c("on_learning_list"), "Learning").otherwise("Gap")
    dims = {n: c(n) for n in ("skill", "requirement", "domain", "location", "is_open", "in_profile", "known_skill")} | {"skill_status": status}
    return MetricView(demand, dims, {"postings_asking": F.count("__key"), "must_have_postings": F.count(F.when(c("__must"), c("__key")))}, once=("job_key", {"__must": F.max(c("requirement") == "must")}))


def market_daily(daily: DataFrame) -> MetricView:
    """New postings add up over days; open postings are averaged over days."""
    days = F.count_distinct("snapshot_day")
    dims = {"day": F.col("snapshot_day"), "week": F.date_trunc("WEEK", "snapshot_day").cast("date"), "company": F.col("company")}
    return MetricView(daily, dims, {"new_postings": F.sum("new_postings"), "avg_open_postings": ratio(F.sum("open_postings"), days), "days_observed": days})
