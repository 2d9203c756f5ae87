"""A retained payload as a tree of addresses with fingerprints, and selected reads of it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fingerprint, property_segment, value_token

_ROW = "array<struct<address:string,kind:string,scalar:string,size:int,fingerprint:string>>"


def _entry(address: Column, kind: str, scalar: Column, size: Column, mark: Column) -> Column:
    return F.array(F.struct(address.alias("address"), F.lit(kind).alias("kind"), scalar.cast("string").alias("scalar"), size.cast("int").alias("size"), mark.alias("fingerprint")))


def _below(value: Column, kind: T.DataType, segments: Column) -> Column:
    """The entries of a value: itself, then all that lies below it."""
    at = F.concat(F.lit("["), segments, F.lit("]"))
    mark = fingerprint(value_token(value, kind))
    null = F.lit(None).cast("string")
    join = lambda s: F.concat(segments, F.when(segments == "", F.lit("")).otherwise(F.lit(",")), s)
    if isinstance(kind, T.StructType):
        parts = [_below(value[f.name], f.dataType, join(property_segment(F.lit(f.name)))) for f in kind.fields]
        own = _entry(at, "record", null, F.lit(len(kind.fields)), mark)
        return F.when(value.isNull(), _entry(at, "scalar", null, F.lit(None), mark)).otherwise(F.concat(own, *parts))
    if isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda x, i: _below(x, kind.elementType, join(i.cast("string"))))
        own = _entry(at, "array", null, F.size(value), mark)
        return F.when(value.isNull(), _entry(at, "scalar", null, F.lit(None), mark)).otherwise(F.concat(own, F.flatten(each)))
    return _entry(at, "scalar", value, F.lit(None), mark)


def shred(df: DataFrame, key: str) -> DataFrame:
    """(key, address, kind, scalar, size, fingerprint): one row for each node of each payload, in one explode."""
    fields = [f for f in df.schema.fields if f.name != key]
    whole = F.struct(*(F.col(f.name) for f in fields))
    entries = _below(whole, T.StructType(fields), F.lit("")).cast(_ROW)
    return df.select(F.col(key).alias("key"), F.explode(entries).alias("e")).select("key", "e.*")


def read_selected(index: DataFrame, key, addresses: list[str]) -> DataFrame:
    """The asked nodes of one payload; an absent address is absent."""
    return index.filter((F.col("key") == key) & F.col("address").isin(addresses))


def has_own(index: DataFrame, parent: str, name: str) -> DataFrame:
    """(key, own): whether each payload's record at ``parent`` has a property of that name."""
    inner = parent[1:-1]
    child = f'[{inner}{"," if inner else ""}"{name}"]'
    return index.filter(F.col("address").isin([parent, child])).groupBy("key").agg(F.bool_or(F.col("address") == child).alias("own"))


def keys_below(index: DataFrame, parent: str) -> DataFrame:
    """(key, names): the child segments under an address."""
    inner = parent[1:-1]
    prefix = f"[{inner}," if inner else "["
    rest = F.expr(f"substring(address, {len(prefix) + 1}, length(address) - {len(prefix) + 1})")  # without the closing bracket
    child = F.col("address").startswith(prefix) & (F.json_array_length("address") == len(json.loads(parent)) + 1)
    return index.filter(child).groupBy("key").agg(F.array_sort(F.collect_list(rest)).alias("names"))


def membership(index: DataFrame, parent: str, name: str, inherited: frozenset | set = frozenset()) -> DataFrame:
    """(key, member): whether each payload's record has the property, itself or among the inherited names."""
    return has_own(index, parent, name).select("key", (F.col("own") | F.lit(name in inherited)).alias("member"))


def node_at(index: DataFrame, address: str) -> DataFrame:
    """(key, kind, scalar, size): the node at an address, without what lies below it."""
    return index.filter(F.col("address") == address).select("key", "kind", "scalar", "size")


def selection(index: DataFrame, keys: DataFrame, address: str, form: str = "fact") -> DataFrame:
    """(key, value): one selected fact, or its fingerprint, of the asked payloads."""
    column = {"fact": "scalar", "fingerprint": "fingerprint"}[form]
    return index.filter(F.col("address") == address).join(keys.select("key"), "key", "left_semi").select("key", F.col(column).alias("value"))


def verified(df: DataFrame, key: str, index: DataFrame) -> bool:
    """Whether a stored index is, as a multiset, what the payload gives."""
    from .evidence import same_rows

    return same_rows(shred(df, key), index)
