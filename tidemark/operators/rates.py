"""Rolling debits, admission instants and retry history as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_spent(debits: DataFrame, gate: str, at: str, cost: str, interval: int) -> DataFrame:
    """Cost committed in the interval before and at each debit; one aged exactly the interval has expired."""
    w = Window.partitionBy(gate).orderBy(at).rangeBetween(-(interval - 1), 0)
    return debits.withColumn("spent", F.sum(cost).over(w))


def next_admission(debits: DataFrame, gate: str, at: str, cost: str, interval: int, units: int, need: int, now: int) -> DataFrame:
    """(gate, admit_at): the earliest instant at which ``need`` fits; now if it does already, null if it never can."""
    live = debits.filter((F.col(at) > now - interval) & (F.col(at) <= now)).groupBy(gate, at).agg(F.sum(cost).alias(cost))
    w = Window.partitionBy(gate).orderBy(at)
    after = F.sum(cost).over(Window.partitionBy(gate)) - F.sum(cost).over(w)  # left once this debit has expired
    steps = live.withColumn("_left", after).withColumn("_all", F.sum(cost).over(Window.partitionBy(gate)))
    free = steps.groupBy(gate).agg(F.min(F.when(F.col("_left") + need <= units, F.col(at) + interval)).alias("_then"), F.first("_all").alias("_all"))
    return free.select(gate, F.when(F.lit(need > units), F.lit(None)).when(F.col("_all") + need <= units, F.lit(now)).otherwise(F.col("_then")).cast("long").alias("admit_at"))


def recent_history(attempts: DataFrame, key: str, order: str, keep: int = 8) -> DataFrame:
    """The last ``keep`` rows of each key and how many earlier ones are omitted."""
    by = Window.partitionBy(key)
    rows = attempts.withColumn("_r", F.row_number().over(by.orderBy(F.desc(order)))).withColumn("_n", F.count("*").over(by))
    return rows.filter(F.col("_r") <= keep).withColumn("omitted", F.greatest(F.lit(0), F.col("_n") - keep)).drop("_r", "_n")


def spent_attempts(attempts: DataFrame, by: list[str], limited) -> DataFrame:
    """Attempts of each run and how many of them were rate limited."""
    return attempts.groupBy(*by).agg(F.count("*").alias("spent"), F.count_if(limited).alias("rate_limited"))


def saturating_counts(events: DataFrame, kind: str, most: int) -> DataFrame:
    return events.groupBy(kind).agg(F.least(F.lit(most), F.count("*")).alias("n"))
