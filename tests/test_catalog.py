"""Every registered engine query against its SQL in DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    def plain(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(repr(tuple(plain(v) for v in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_payload_trees_of_all_orders(spark, duck):
    t = catalog.Tables(spark, SF)
    index = catalog.tree.shred(catalog.payloads(t), "o_orderkey")
    want = duck.sql(catalog.TREE_ROWS.replace(" WHERE o_orderkey % 5 = 0", "")).df()
    assert rows(index.drop("fingerprint").toPandas()) == rows(want)
    keys = {r[0] for r in t.orders.select("o_orderkey").collect()}
    assert {r.key for r in catalog.tree.has_own(index, '["head"]', "o_custkey").filter("own").collect()} == keys
    assert {r.key: r.names for r in catalog.tree.keys_below(index, '["head"]').collect()} == dict.fromkeys(keys, ['"o_custkey"', '"o_orderstatus"'])
