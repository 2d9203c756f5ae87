"""Usage: intents, reports, estimates, resource reports. A missing report is unknown, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import safe_sum

DEFAULT_RETENTION_MS = 3_600_000


def usage_by_unit(quantities: DataFrame, unit: str = "unit", amount: str = "amount") -> DataFrame:
    return quantities.groupBy(unit).agg(safe_sum(F.sum(amount)).alias("total"))


def scoped_usage(attempts: DataFrame, reports: DataFrame, quantities: DataFrame, on: str) -> DataFrame:
    """Attempts with their reports and quantities; both joins keep attempts without any."""
    return attempts.join(reports, on, "left").join(quantities, [on, "report"], "left")


def unknown_attempts(attempts: DataFrame, reports: DataFrame, on: str) -> DataFrame:
    return attempts.join(reports.select(on), on, "left_anti")


def usage_summary(attempts: DataFrame, reports: DataFrame, quantities: DataFrame, on: str) -> DataFrame:
    """Counts, unknown attempts and completeness; each report counts once however many quantities it has."""
    known = reports.groupBy(on).agg(F.count("*").alias("reports"))
    rows = attempts.select(on).join(known, on, "left")
    counts = rows.agg(F.count("*").alias("attempts"), F.coalesce(F.sum("reports"), F.lit(0)).alias("reports"), F.count_if(F.col("reports").isNull()).alias("unknown"))
    return counts.withColumn("status", F.when(F.col("unknown") == 0, "complete").otherwise("incomplete"))


def estimates(est: DataFrame, quantities: DataFrame, on: str) -> DataFrame:
    """Each estimate with its quantities regrouped by unit."""
    packed = quantities.groupBy(on).agg(F.array_sort(F.collect_list(F.struct("unit", "amount"))).alias("quantities"))
    return est.join(packed, on, "left")


def estimates_by_scope(est: DataFrame, scope: str, basis: str, amount: str) -> DataFrame:
    """Counts and sums of estimates by scope and basis."""
    return est.groupBy(F.col(scope).alias("scope"), F.col(basis).alias("basis")).agg(F.count("*").alias("n"), safe_sum(F.sum(amount)).alias("amount"))


def acknowledge(known: DataFrame, arriving: DataFrame, intents: DataFrame, key: list[str], attempt: str, content: str) -> DataFrame:
    """Arriving reports as acknowledged, duplicate, conflict (the first is kept) or unattributable."""
    first = known.select(*key, F.col(content).alias("_had"))
    rows = arriving.join(first, key, "left").join(intents.select(attempt, F.lit(True).alias("_known")).distinct(), attempt, "left")
    state = (
        F.when(F.col("_known").isNull(), "unattributable").when(F.col("_had").isNull(), "acknowledged")
        .when(F.col("_had").eqNullSafe(F.col(content)), "duplicate").otherwise("conflict")
    )
    return rows.withColumn("outcome", state).drop("_had", "_known")


def expires_at(observed: Column, valid_until: Column, retention: Column | None = None) -> Column:
    return F.coalesce(valid_until, observed + F.coalesce(retention, F.lit(DEFAULT_RETENTION_MS)) if retention is not None else observed + DEFAULT_RETENTION_MS)


def live_reports(reports: DataFrame, now: int) -> DataFrame:
    return reports.filter(F.col("expires_at") > now)


def next_expiry(reports: DataFrame, now: int) -> DataFrame:
    return live_reports(reports, now).agg(F.min("expires_at").alias("next_expiry"))


def evicted(reports: DataFrame, now: int) -> DataFrame:
    """What stays after eviction."""
    return reports.filter(~(F.col("expires_at") <= now))
