"""The market view: a row per valid posting with what is known about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.operators import rules


def largest_group(rows: DataFrame, group: str = "company", where: Column | None = None) -> DataFrame:
    """The value with most rows, the first by name among equals: one row."""
    return (rows if where is None else rows.where(where)).groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(1).select(group)


def market_view(good: DataFrame, requirements: DataFrame, fits: DataFrame, as_of: Column) -> DataFrame:
    """Left joins: a posting is in the market when it is valid, whether or not a model has read it yet.

    It is enriched once it has both, requirements and a fit.
    """
    read = requirements.select("job_key", "seniority", "domain", "work_mode", "years_min", "cloud", "must_have_skills", F.lit(True).alias("__read"))
    fitted = fits.select("job_key", "fit_score", "recommendation", "missing_skills", "learning_gaps", "matched_skills", F.lit(True).alias("__fitted"))
    rows = good.join(read, "job_key", "left").join(fitted, "job_key", "left")
    days = F.datediff(as_of, F.coalesce("posted_date", "first_seen"))
    out = rows.select(
        "job_key", "company", "title", rules.city("location").alias("city"), "location", "work_mode", rules.level("seniority", "title").alias("seniority"), F.col("years_min").alias("years_required"),
        rules.industry("domain").alias("domain"), F.col("domain").alias("domain_detail"), "cloud", "must_have_skills", "fit_score", "recommendation", "missing_skills", "learning_gaps", "matched_skills", "is_open", "first_seen", "last_seen", "days_seen", "source", "url",
        (F.col("__read").isNotNull() & F.col("__fitted").isNotNull()).alias("is_enriched"), "posted_date", days.alias("days_since_posted"), rules.age_bucket(days).alias("posting_age"), "last_full_fetch",
    )
    top = largest_group(good, "company", F.col("is_open")).select(F.col("company").alias("__top"))
    return out.join(F.broadcast(top), F.col("company") == F.col("__top"), "left").withColumn("from_largest_company", F.col("__top").isNotNull()).drop("__top")
