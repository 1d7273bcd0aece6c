"""Named checks with thresholds, their log, and the decision to go on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """``value <= threshold`` passes; a blocking check that fails stops publication."""

    name: str
    rows: DataFrame
    value: Column
    threshold: float
    blocking: bool
    when_empty: float = 0.0
    detail: Column | str = ""


def run(checks: Sequence[Check]) -> DataFrame:
    """``check_name, value, threshold, passed, blocking, detail``; checks on the same rows share one pass."""
    groups: dict[int, list[Check]] = {}
    for c in checks:
        groups.setdefault(id(c.rows), []).append(c)
    out = None
    for own in groups.values():
        details = [(F.lit(c.detail) if isinstance(c.detail, str) else c.detail).alias(f"{c.name} detail") for c in own]
        one = own[0].rows.agg(*[F.coalesce(c.value.cast("double"), F.lit(c.when_empty)).alias(c.name) for c in own], *details)
        rows = F.array(*[F.struct(F.lit(c.name).alias("check_name"), F.col(c.name).alias("value"), F.lit(float(c.threshold)).alias("threshold"), F.lit(c.blocking).alias("blocking"), F.col(f"{c.name} detail").alias("detail")) for c in own])
        part = one.select(F.explode(rows).alias("c")).select("c.*")
        out = part if out is None else out.unionByName(part)
    return out.select("check_name", "value", "threshold", (F.col("value") <= F.col("threshold")).alias("passed"), "blocking", "detail")


def log_rows(checked: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows of :func:`run` for the log, with ``checked_at``; append them with :func:`snaplake.operators.upsert.append_log`."""
    return checked.select((at if at is not None else F.current_timestamp()).alias("checked_at"), "*")


def standard_checks(all_postings: DataFrame, clean: DataFrame, log: DataFrame, fits: DataFrame, gave_up: DataFrame, rows: DataFrame, as_of: Column) -> list[Check]:
    """Freshness, quarantine and warning rates, error rate, given up, unscored, duplicates.

    The quarantine rate is of all postings, the warning rate of the clean ones alone.
    """
    n, bad, warned, failed = F.count("*"), F.count_if(F.size("dq_errors") > 0), F.count_if(F.size("dq_warnings") > 0), F.count_if("failed")
    total = F.nullif(n, F.lit(0))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    scored = clean.where("is_open").select("job_key").join(fits.select("job_key"), "job_key", "left_anti")
    return [
        Check("fresh_board_snapshot_days", rows, F.datediff(as_of, F.max(F.when(F.col("source") != "manual", F.col("snapshot_day")))), 2, True, 999.0, "days since the latest board snapshot"),
        Check("quarantine_rate", all_postings, bad / total, 0.25, True, 0.0, said(bad, " of ", n, " postings quarantined")),
        Check("warning_rate", clean, warned / total, 0.25, False, 0.0, said(warned, " of ", n, " clean postings have a warning")),
        Check("enrichment_error_rate_24h", log, failed / total, 0.20, True, 0.0, said(failed, " errors, ", n - failed, " successes")),
        Check("enrichment_given_up", gave_up, n, 0, False, 0.0, "skipped after repeated failures"),
        Check("open_postings_without_score", scored, n, 0, False, 0.0, "waiting for a score"),
        Check("duplicate_postings_in_silver", clean, n - F.count_distinct("job_key"), 0, True, 0.0, "should be none"),
    ]


def gate_state(log: DataFrame, *order: Column) -> DataFrame:
    """One row: how many blocking checks failed at their latest run, and when the last check ran."""
    from snaplake.operators.fetch_state import latest_per_group

    latest = latest_per_group(log, "check_name", *order)
    return latest.agg(F.count_if(F.col("blocking") & ~F.col("passed")).alias("failed_blocking"), F.max("checked_at").alias("last_check"))


def require_passed(state: DataFrame) -> None:
    """Raise if the gate is shut."""
    failed = state.first()["failed_blocking"]
    if failed:
        raise RuntimeError(f"not published: {failed} blocking checks failed in the latest run")
