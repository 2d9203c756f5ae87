"""Readers with their checks; anything malformed is refused as a whole."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROSTER = "employee_id string, github_login string, name string, active boolean"


class Malformed(ValueError):
    pass


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """The rows as they are, or Malformed if a key repeats or is null."""
    bad = df.groupBy(*keys).count().filter(" or ".join(["count > 1", *(f"{k} is null" for k in keys)])).limit(1).collect()
    if bad:
        raise Malformed(f"duplicate or missing {', '.join(keys)}: {bad[0]}")
    return df


def known(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """The rows as they are, or Malformed if a key is not among the other table's."""
    bad = df.join(other.select(F.col(other_key).alias(key)), key, "left_anti").limit(1).collect()
    if bad:
        raise Malformed(f"unknown {key}: {bad[0]}")
    return df


def read_world(spark: SparkSession, profiles: str, pulls: str, reviews: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JSON-lines fixtures with unique ids and known authors."""
    p = unique(spark.read.schema("key string, id string, name string, avatarUrl string").json(profiles), "key")
    q = unique(spark.read.schema("number long, author string, createdAt string, merged boolean, labels array<string>").json(pulls), "number")
    r = unique(spark.read.schema("id string, author string, pullRequest long, submittedAt string, state string").json(reviews), "id")
    return p, known(q, "author", p, "key"), known(r, "author", p, "key")


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """A roster CSV with exactly the known header, unique ids and boolean literals."""
    head = spark.read.text(path).limit(1).first()
    if head is None or [h.strip('"') for h in head[0].split(",")] != [c.split()[0] for c in ROSTER.split(", ")]:
        raise Malformed("the header differs")
    rows = spark.read.csv(path, schema=ROSTER, header=True, mode="FAILFAST", enforceSchema=False)
    return unique(rows, "employee_id")


def select_people(roster: DataFrame, selected: list[str]) -> DataFrame:
    """Exactly the selected active people, each named once."""
    if len(set(selected)) != len(selected):
        raise Malformed("a person is selected twice")
    got = roster.filter(F.col("employee_id").isin(selected) & F.col("active"))
    if got.count() != len(selected):
        raise Malformed("a selected person is unknown or inactive")
    return got


def read_details(spark: SparkSession, pulls: str, discussions: str) -> tuple[DataFrame, DataFrame]:
    """Details and discussions of pull requests as JSON lines: unique ids, and a discussion only of a known one."""
    item = "array<struct<id:long,body:string,author:string,at:long>>"
    p = unique(spark.read.schema("id string, title string, body string, diff string, merged boolean, terminalAt long, latestActivity long, complete boolean, labels array<string>").json(pulls), "id")
    d = unique(spark.read.schema(f"id string, reviews {item}, comments {item}, inlineComments {item}, latestActivity long, complete boolean").json(discussions), "id")
    return p, known(d, "id", p, "id")


def discussion_items(discussions: DataFrame) -> DataFrame:
    """(id, kind, item, author, at): every review, comment and inline comment, a row each."""
    items = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: F.struct(F.lit(c).alias("kind"), x["id"].alias("item"), x["author"].alias("author"), x["at"].alias("at")))
    kinds = F.array(*map(items, ("reviews", "comments", "inlineComments")))
    return discussions.select("id", F.explode(F.flatten(kinds)).alias("x")).select("id", "x.*")


def expired_claims(subjects: DataFrame, key: str, lease: str, now, limit: int) -> DataFrame:
    """The subjects whose lease ended before now, the longest expired first."""
    return subjects.filter(F.col(lease) < now).orderBy(lease, key).limit(limit).select(F.col(key).alias("subject"), F.col(lease).alias("lease"))


def bisect_days(start: date, end: date, count: Callable[[date, date], int], most: int) -> list[tuple[date, date]]:
    """Half-open day ranges with at most ``most`` results each; a single day beyond that is an error."""
    todo, out = [(start, end)], []
    while todo:
        a, b = todo.pop()
        if a >= b:
            continue
        if count(a, b) <= most:
            out.append((a, b))
        elif (b - a).days <= 1:
            raise Malformed(f"{a} has more than {most} results")
        else:
            mid = a + timedelta(days=(b - a).days // 2)
            todo += [(mid, b), (a, mid)]
    return out


class _Pages(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class PagedSource(DataSource):
    """A numbered collection read page by page; options: pages, size, conflict (the page that lies)."""

    @classmethod
    def name(cls):
        return "tidemark_pages"

    def schema(self):
        return "page int, id long, identity string, exhausted boolean"

    def reader(self, schema):
        return _PageReader(int(self.options.get("pages", 2)), int(self.options.get("size", 10)))


class _PageReader(DataSourceReader):
    def __init__(self, pages: int, size: int):
        self.pages, self.size = pages, size

    def partitions(self):
        return [_Pages(p, p + 1) for p in range(self.pages)]

    def read(self, partition):
        for page in range(partition.start, partition.end):
            for i in range(self.size):
                yield page, page * self.size + i, f"item-{page * self.size + i}", page + 1 == self.pages


class RowStore:
    """The in-memory row store: subjects with versions, compare and set, generations, fields, claims."""

    def __init__(self):
        self.subjects: dict[str, dict] = {}
        self.generations: dict[tuple[str, int], dict] = {}
        self.fields: dict[tuple[str, str], tuple] = {}

    def put_subject(self, key: str, **data) -> None:
        self.subjects[key] = {**data, "version": self.subjects.get(key, {}).get("version", 0) + 1}

    def get_subject(self, key: str) -> dict | None:
        return dict(self.subjects[key]) if key in self.subjects else None

    def cas_subject(self, key: str, expected: int, **patch) -> bool:
        now = self.subjects.get(key)
        if now is None or now["version"] != expected:
            return False
        self.subjects[key] = {**now, **patch, "version": expected + 1}
        return True

    def put_generation(self, key: str, number: int, **data) -> None:
        if (key, number) in self.generations:
            raise ValueError("a generation is written once")
        self.generations[key, number] = data

    def list_generations(self, key: str) -> list[int]:
        return sorted(n for k, n in self.generations if k == key)

    def put_fields(self, key: str, values: dict) -> None:
        import hashlib

        for path, v in values.items():
            self.fields[key, path] = (v, hashlib.sha256(repr(v).encode()).hexdigest())

    def get_fields(self, key: str, paths: list[str]) -> dict:
        return {p: self.fields[key, p][0] for p in paths if (key, p) in self.fields}

    def get_fingerprints(self, key: str, paths: list[str]) -> dict:
        return {p: self.fields[key, p][1] for p in paths if (key, p) in self.fields}

    def expired_claims(self, now: int, limit: int) -> list[str]:
        late = sorted((s["lease_until"], k) for k, s in self.subjects.items() if s.get("lease_until") is not None and s["lease_until"] < now)
        return [k for _, k in late[:limit]]
