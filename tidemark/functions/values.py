"""Canonical tokens, fingerprints and the small scalar functions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest integer that a quantity, time or revision may have.
SAFE = 9007199254740991
VERSION_TAG = "TMV1"


def fingerprint(text: Column) -> Column:
    """SHA-256 hex of a text; null stays null."""
    return F.sha2(text.cast("binary"), 256)


def number_token(x: Column) -> Column:
    """A token that keeps -0.0, NaN and the infinities apart from all other numbers."""
    return x.cast("double").cast("string")


def value_token(col: Column, kind: T.DataType | None = None) -> Column:
    """An injective token of a value: its kind, then its text; null has a kind of its own."""
    tag = "s"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        tag, col = "d", number_token(col)
    elif isinstance(kind, (T.IntegralType, T.BooleanType, T.DecimalType)):
        tag = "n"
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        tag = "t"
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        tag, col = "j", F.to_json(col)
    text = col.cast("string")
    return F.when(col.isNull(), F.lit("0:")).otherwise(F.concat(F.lit(tag), F.length(text).cast("string"), F.lit(":"), text))


def row_token(df, columns: list[str]) -> Column:
    """The tokens of some columns in name order: the order of columns never matters."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.concat(F.lit(f"{len(c)}:{c}="), value_token(F.col(c), kinds[c])) for c in sorted(columns)]
    return F.concat(F.lit(VERSION_TAG), *parts)


def safe_sum(total: Column, what: str = "quantity") -> Column:
    """The sum, or an error beyond the safe integers."""
    return F.when(F.abs(total) > SAFE, F.raise_error(F.lit(f"{what} overflows the safe integers"))).otherwise(total)


def safe_add(a: Column, b: Column) -> Column:
    return safe_sum(F.try_add(a.cast("long"), b.cast("long")))


def retry_delay(n: Column) -> Column:
    """Milliseconds before attempt n + 1: doubles from 2 s, at most a minute."""
    return F.least(F.lit(60000.0), F.lit(2000.0) * F.pow(F.lit(2.0), F.least(n - 1, F.lit(30)))).cast("long")


def in_window(at: Column, start, end) -> Column:
    """start <= at < end."""
    return (at >= start) & (at < end)


def quiet_final(terminal: Column, latest: Column, complete: Column, cutoff, quiet_seconds: int) -> Column:
    """Complete, ended, and without activity for the quiet period at the cutoff."""
    return F.coalesce(complete & terminal.isNotNull() & (latest + quiet_seconds * 1000 <= cutoff), F.lit(False))


def one_space(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), "^ | $", "")


def is_identifier(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z][A-Za-z0-9._-]{0,127}$")


def canonical_order(key: Column) -> Column:
    """Sort expression of keys by UTF-16 code units."""
    return F.encode(key, "UTF-16BE")


def reference_for(store: Column, analysis: Column, environment: Column, result: Column) -> Column:
    """The canonical locator string of a result."""
    return F.to_json(F.array(store, analysis, environment, result))


def parse_reference(ref: Column) -> Column:
    """Its parts, or null if the string isn't canonical."""
    parts = F.from_json(ref, "array<string>")
    fine = (F.size(parts) == 4) & ~F.exists(parts, lambda p: p.isNull()) & (F.to_json(parts) == ref)
    return F.when(fine, F.struct(parts[0].alias("store"), parts[1].alias("analysis"), parts[2].alias("environment"), parts[3].alias("result_id")))


def encode_address(*segments: Column) -> Column:
    """JSON path array; property "0" and index 0 stay distinct."""
    return F.concat(F.lit("["), F.concat_ws(",", *segments), F.lit("]"))


def property_segment(key: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(key)), r"^\[|\]$", "")


def index_segment(i: Column) -> Column:
    return i.cast("long").cast("string")


def count_noun(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def prefixes(address: Column) -> Column:
    """All prefixes of an address array, the empty one included."""
    return F.transform(F.sequence(F.lit(0), F.size(address)), lambda n: F.slice(address, 1, n))


def encode_value(text: Column) -> Column:
    """Canonical JSON of a JSON text: no spaces, strings escaped one way; null if it is no JSON. Keys of objects come in order."""
    return F.try_parse_json(text).cast("string")


def decode_value(text: Column) -> Column:
    """The value of a canonical JSON text; null if the text is not the one that encoding its value gives."""
    return F.when(encode_value(text) == text, F.try_parse_json(text))


def record_from_entries(entries: Column) -> Column:
    """A map of (key, value) entries; a repeated key is an error."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_entries(entries)).otherwise(F.raise_error(F.lit("a key is given twice")))


def json_each(text: Column, kind: str = "array<string>") -> Column:
    """One row for each element of a JSON array; none for a text that is no array."""
    return F.explode(F.from_json(text, kind))


DAY_MS = 86_400_000


def day_of(at_ms: Column) -> Column:
    """The day, counted from the epoch, in which an instant lies; days are half open."""
    return F.floor(at_ms / DAY_MS).cast("long")


def closed_days(start_ms: Column, end_ms: Column, now_ms) -> Column:
    """The whole days of a half-open window that are over: (first, count); a day still open at ``now_ms`` isn't counted."""
    first = F.ceil(start_ms / DAY_MS).cast("long")
    last = F.floor(F.least(end_ms, F.lit(now_ms) if isinstance(now_ms, int) else now_ms) / DAY_MS).cast("long")
    return F.struct(first.alias("first"), F.greatest(last - first, F.lit(0)).alias("n"))


__all__ = [n for n, v in list(globals().items()) if not n.startswith("_") and n not in ("annotations", "Column", "F", "T")]
