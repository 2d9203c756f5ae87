"""Calls of one step by another, with arguments, and sources with arguments.

A call's arguments are recipes: a column handed on, or an expression of columns. Equal
arguments are one call, whichever rows make it and in whichever run: the called template is
keyed by the digest of the arguments, which are all of its evidence. What can't be made
again from recorded facts, such as a function, is no argument.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import row_token
from .compose import Memo, Source, Step, Template
from .identity import Unjustified, code_digest


@dataclass(frozen=True)
class Forwarded:
    """A column of the caller, handed on as it is."""

    column: str

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,)

    @property
    def sql(self) -> str:
        return f"`{self.column}`"


@dataclass(frozen=True)
class Derived:
    """An expression over columns of the caller, all of which it names."""

    sql: str
    columns: tuple[str, ...]


def with_arguments(df: DataFrame, recipes: dict[str, Forwarded | Derived]) -> DataFrame:
    """The caller's rows with a column ``digest`` of their arguments."""
    made = df.select("*", *(F.expr(r.sql).alias(f"_arg_{n}") for n, r in recipes.items()))
    return made.withColumn("digest", F.sha2(row_token(made, [f"_arg_{n}" for n in recipes]).cast("binary"), 256))


def call(name: str, caller: Step, columns: list[str], recipes: dict[str, Forwarded | Derived], body: Callable[..., DataFrame], returns: list[str], version: str = "1") -> Memo:
    """The caller's ``columns`` with what the call returned for each row and its ``status``.

    ``body(_members)`` gets (key, arguments), each tuple of arguments once, and returns rows with ``key`` and ``returns``.
    """
    if bad := [n for n, r in recipes.items() if not isinstance(r, (Forwarded, Derived))]:
        raise Unjustified(f"unreconstructible-argument: {', '.join(bad)}")
    used = sorted({c for r in recipes.values() for c in r.columns})
    made = tuple(sorted(recipes.items()))

    def arguments(caller):
        rows = with_arguments(caller, dict(made))
        return rows.groupBy("digest").agg(*(F.first(f"_arg_{n}").alias(n) for n, _ in made))

    def joined(caller, returned):
        rows = with_arguments(caller, dict(made)).select(*columns, F.col("digest").alias("key"))
        return rows.join(returned, "key", "left").drop("key")

    found = Memo(f"{name}.arguments", {"caller": caller}, {"caller": used}, arguments, version=version)
    each = Template(name, found, "digest", {}, {"_members": sorted(recipes)}, body, version=version)
    both = sorted({*columns, *used})
    return Memo(f"{name}.calls", {"caller": caller, "returned": each}, {"caller": both, "returned": ["key", "status", *returns]}, joined, version=version)


def source_with(name: str, run: Callable[..., DataFrame | None], arguments: dict, finality=None, version: str = "1") -> Source:
    """A source that takes arguments; other arguments, or another implementation, are another source."""
    mark = code_digest(lambda: arguments, run)[:16]
    return Source(f"{name}[{mark}]", lambda previous: run(previous, **arguments), finality, version=version)
