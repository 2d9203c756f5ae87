"""Consumed facts: digests, comparison and what a change reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import row_token


def key_evidence(df: DataFrame, key: str, consumed: list[str], salt: str = "") -> DataFrame:
    """(key, evidence): one digest for each key over its rows' consumed columns, whatever their order.

    Sums and exclusive-or of two hashes with the count combine map-side, so that a key with
    any number of rows needs constant room. The hashes start from different seeds, so that rows
    which one can't tell apart the other can.
    """
    token = row_token(df, [c for c in consumed if c != key])
    rows = df.select(F.col(key).cast("string").alias("key"), F.xxhash64(F.lit(1), token).alias("a"), F.xxhash64(F.lit(f"2|{salt}"), token).alias("b"))
    parts = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("a").alias("x"), F.sum(F.col("a").cast("decimal(38,0)")).alias("s"), F.bit_xor("b").alias("y"), F.sum(F.col("b").cast("decimal(38,0)")).alias("t"))
    return parts.select("key", F.sha2(F.concat_ws("|", F.lit(salt), "n", "x", "s", "y", "t").cast("binary"), 256).alias("evidence"))


def projection_digest(df: DataFrame, group: list[str], key: Column, value: Column) -> DataFrame:
    """A canonical digest of one selected field over the members of bounded groups."""
    pairs = F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v"))))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(p["k"].cast("string"), F.lit("="), p["v"].cast("string"))), "\n")
    return df.groupBy(*group).agg(F.sha2(text.cast("binary"), 256).alias("digest"))


#: What a body may observe of a value, and the part of its shredded index that answers: the columns of a node that are its evidence.
OBSERVATIONS = {
    "value": ["kind", "scalar", "fingerprint"], "own": ["present"], "membership": ["present"], "length": ["size"], "keys": ["names"],
    "container-kind": ["kind"], "navigate": ["kind"], "order": ["place"],
}


def observe(index: DataFrame, address: str, operation: str, name: str | None = None) -> DataFrame:
    """(key, fact): what one observation of each payload sees, and no more: a length is no element, a node no subtree."""
    from . import tree

    if operation not in OBSERVATIONS:
        raise ValueError(f"no observation is called {operation}")
    if operation == "own":
        return tree.has_own(index, address, name).select("key", F.col("own").cast("string").alias("fact"))
    if operation == "keys":
        return tree.keys_below(index, address).select("key", F.array_join("names", ",").alias("fact"))
    node = index.filter(F.col("address") == address)
    fact = {"value": F.coalesce("fingerprint", "scalar"), "length": F.col("size").cast("string"), "container-kind": F.col("kind"), "navigate": F.col("kind")}
    if operation not in fact:
        raise ValueError(f"{operation} is observed of members, not of a payload")
    return node.select("key", fact[operation].alias("fact"))


def first_difference(recorded: DataFrame, current: DataFrame, on: list[str], order: str, fact: str) -> DataFrame:
    """The first fact, in the order of consumption, that is not equal; no row if all are."""
    state = compare_facts(recorded, current, on, fact).filter("state not in ('equal', 'added')")
    return state.join(recorded.select(*on, order), on, "left").orderBy(order, *on).limit(1)


def compare_facts(recorded: DataFrame, current: DataFrame, on: list[str], fact: str) -> DataFrame:
    """Each recorded or current fact as equal, changed, unavailable (gone) or added."""
    a = recorded.select(*on, F.col(fact).alias("_was"), F.lit(1).alias("_a"))
    b = current.select(*on, F.col(fact).alias("_is"), F.lit(1).alias("_b"))
    state = F.when(F.col("_b").isNull(), "unavailable").when(F.col("_a").isNull(), "added").when(F.col("_was").eqNullSafe(F.col("_is")), "equal").otherwise("changed")
    return a.join(b, on, "full").select(*on, state.alias("state"))


def membership_change(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(change, key): keys added and removed."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    gone = a.join(b, key, "left_anti").withColumn("change", F.lit("removed"))
    new = b.join(a, key, "left_anti").withColumn("change", F.lit("added"))
    return gone.unionByName(new).select("change", key)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Multiset equality."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def merge_pages(pages: DataFrame, identity: str, facts: list[str]) -> DataFrame:
    """One row for each identity; ``conflict`` where pages disagree on the facts."""
    token = row_token(pages, facts)
    return pages.withColumn("_t", F.xxhash64(token)).groupBy(identity).agg(F.count("*").alias("copies"), (F.min("_t") != F.max("_t")).alias("conflict"))
