"""The contribution report over customers and orders: the flagship analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .compose import Fold, Memo, Source, Template

LEAST_ORDERS = 5


def summarise(_members: DataFrame, orders: DataFrame) -> DataFrame:
    """Count, total and largest order of each member."""
    sums = orders.groupBy("key").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_totalprice").alias("largest"))
    return _members.join(sums, "key").select("key", "c_nationkey", "n_orders", "total", "largest")


def per_nation(members: DataFrame) -> DataFrame:
    return members.groupBy("c_nationkey").agg(F.count("*").alias("members"), F.sum("n_orders").alias("orders"), F.round(F.sum("total"), 2).alias("total"), F.max("largest").alias("largest"))


def with_counts(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers with their number of orders, on which the gate decides."""
    n = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("authored"))
    return customers.join(n, "c_custkey", "left").withColumn("authored", F.coalesce("authored", F.lit(0)))


def contribution(customers, orders, least: int = LEAST_ORDERS) -> Fold:
    """``customers`` and ``orders`` are source functions (previous) -> DataFrame or None."""
    people, work = Source("customers", customers), Source("orders", orders)
    found = Memo("contributors", {"customers": people, "orders": work}, {"customers": ["c_custkey", "c_nationkey"], "orders": ["o_custkey"]}, with_counts)
    each = Template(
        "summary", found, "c_custkey", {"orders": (work, "o_custkey")}, {"_members": ["c_nationkey"], "orders": ["o_totalprice"]}, summarise,
        gate=lambda m: F.col("authored") >= least,
    )
    return Fold("report", each, ["c_nationkey", "n_orders", "total", "largest"], per_nation)


def read(spark: SparkSession, sf_dir: str, table: str):
    return lambda previous: spark.read.parquet(f"{sf_dir}/{table}.parquet")
