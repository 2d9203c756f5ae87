"""Keying, gates, readiness and folds over keyed members."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canonical_order
from ..sources.scratch import Scratch

#: Keying failures by precedence.
FAILURES = ("malformed-snapshot", "key-function-failed", "missing-key", "non-string-key", "empty-key", "duplicate-key")
STATUSES = ("succeeded", "skipped", "failed", "cancelled", "pending")


class KeyingError(ValueError):
    """A collection that can't be keyed; nothing of it is used."""


def key_failures(df: DataFrame, key: Column) -> DataFrame:
    """(reason, key, n): every way in which the rows fail to be keyed."""
    keyed = df.select(key.cast("string").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    reason = F.when(F.col("key").isNull(), "missing-key").when(F.col("key") == "", "empty-key").when(F.col("n") > 1, "duplicate-key")
    return keyed.withColumn("reason", reason).filter("reason is not null").select("reason", "key", "n")


def first_failure(failures: DataFrame) -> DataFrame:
    """The failure to report: by precedence of reason, then the least key."""
    rank = F.array_position(F.array(*map(F.lit, FAILURES)), F.col("reason"))
    best = failures.agg(F.min(F.struct(rank.alias("precedence"), canonical_order(F.coalesce("key", F.lit(""))).alias("o"), "reason", "key", "n")).alias("m"))
    return best.filter("m is not null").select("m.reason", "m.key", "m.n")


def keyed(df: DataFrame, key: Column) -> DataFrame:
    """The rows with a column ``key``; raises KeyingError unless keys are present, non-empty and unique."""
    bad = first_failure(key_failures(df, key)).first()
    if bad:
        raise KeyingError(f"{bad['reason']}: {bad['key']!r}")
    return df.withColumn("key", key.cast("string"))


def gate_status(gate: Column) -> Column:
    """True: required, false: skipped, null: failed (never skipped)."""
    return F.when(gate, F.lit("required")).when(~gate, F.lit("skipped")).otherwise(F.lit("failed"))


def status_lists(members: DataFrame) -> DataFrame:
    """(status, n, first_key, last_key) of settled members; keys themselves stay distributed."""
    return members.groupBy("status").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def _ranges(scratch: Scratch, df: DataFrame, order: list, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows in ranges of the order, numbered by ``_part``, and for each range (and ``by``) the rows ``_before`` it.

    The ranges are a table: Spark draws their bounds from samples and merges small ones, anew for each use of a plan,
    so that rows and counts of two uses are of other ranges."""
    ranged = scratch.table(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(*by, "_part").count()  # a row for each range
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return ranged, counts.withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")


def status_keys(members: DataFrame) -> DataFrame:
    """(status, place, key): the keys of each status in canonical order, a row each; places count from 1.

    Ranges of keys are numbered apart and shifted by the counts of the ranges before them, so that no status is one task's."""
    order, scratch = canonical_order(F.col("key").cast("string")), Scratch(members.sparkSession, "status_keys")
    ranged, before = _ranges(scratch, members.select("status", "key"), ["status", order], ["status"])
    own = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("status", "_part").orderBy(order)))
    return scratch.only(own.join(before, ["status", "_part"]).select("status", (F.col("_r") + F.col("_before")).alias("place"), "key"), "places")


def places(df: DataFrame, order: Column, name: str = "place") -> DataFrame:
    """The rows with their place, from 1, in one order over all of them. Ranges are numbered apart and shifted by the
    counts of those before, so that only a row for each range comes to one task. Rows of equal rank are in any order."""
    scratch = Scratch(df.sparkSession, "places")
    ranged, before = _ranges(scratch, df, [order], [])
    own = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return scratch.only(own.join(before, "_part").withColumn(name, F.col("_r") + F.col("_before")).drop("_part", "_r", "_before"), "places")


def entries(members: DataFrame, columns: list[str]) -> DataFrame:
    """(key, status, data): data is a struct for succeeded members and null for all others; a row that breaks this raises."""
    data = F.struct(*columns)
    return members.select("key", "status", F.when(F.col("status") == "succeeded", data).alias("data"))


def entry_data(entry: DataFrame, column: str) -> Column:
    """A field of an entry's data; reading it of a member that has not succeeded is an error."""
    return F.when(entry["status"] == "succeeded", entry["data"][column]).otherwise(F.raise_error(F.concat(F.lit("no data: "), entry["key"], F.lit(" is "), entry["status"])))


def per_member(df: DataFrame, body: Callable, schema: str) -> DataFrame:
    """``body(key, pandas rows) -> dict`` for each key, in its own group: a row with status and error for each key.

    An error stays with its member. For bodies that no expression can state; a key's rows come to one task."""
    import pandas as pd

    def run(key, rows):
        try:
            got = {"key": key[0], **body(key[0], rows), "status": "succeeded", "error": None}
        except Exception as e:
            got = {"key": key[0], "status": "failed", "error": f"{type(e).__name__}: {e}"}
        return pd.DataFrame([got]).reindex(columns=names)

    names = ["key", *(f.split()[0] for f in schema.split(",")), "status", "error"]
    return df.groupBy("key").applyInPandas(run, f"key string, {schema}, status string, error string")

@dataclass(frozen=True)
class Readiness:
    """Whether a fold may run: ready, waiting or failed, with the counts behind it."""

    state: str
    counts: dict = field(default_factory=dict)
    open_discovery: bool = False


def readiness(members: DataFrame, discovery: str = "complete", outcome: bool = False) -> Readiness:
    """One aggregate decides. Skipped members never block; an empty complete population is ready."""
    return settled(members.agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES)).first().asDict(), discovery, outcome)


def settled(row: dict, discovery: str = "complete", outcome: bool = False) -> Readiness:
    """``readiness`` from counts by status."""
    if discovery in ("rejected", "cancelled"):
        return Readiness("failed", row, False)
    still = discovery in ("open", "denied") or row["pending"] > 0
    if not outcome and row["failed"] + row["cancelled"] > 0:
        return Readiness("failed", row, discovery == "open")
    return Readiness("waiting" if still else "ready", row, discovery == "open")


def strict_fold(members: DataFrame, body: Callable[[DataFrame], DataFrame], discovery: str = "complete") -> tuple[Readiness, DataFrame | None]:
    """The body over succeeded members, only when all required ones have succeeded."""
    state = readiness(members, discovery)
    return state, body(members.filter("status = 'succeeded'")) if state.state == "ready" else None


def outcome_fold(members: DataFrame, body: Callable[[DataFrame], DataFrame], discovery: str = "complete") -> tuple[Readiness, DataFrame | None]:
    """The body over all settled members, failed and cancelled ones included; only succeeded ones carry data."""
    state = readiness(members, discovery, outcome=True)
    data = [F.when(F.col("status") == "succeeded", F.col(c)).alias(c) if c not in ("key", "status") else F.col(c) for c in members.columns]
    return state, body(members.select(*data)) if state.state == "ready" else None


def member_order_digest(df: DataFrame, group: list[str], position: str, key: Column) -> DataFrame:
    """A digest of the order in which a bounded group gives its keys."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position), key.alias("k"))))
    return df.groupBy(*group).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["k"].cast("string")), "\n").cast("binary"), 256).alias("order_digest"))


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")
