"""Traversal of pages as micro-batches: a frontier grows batch by batch and completes once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import merge_pages
from ..plans.compose import Source


class Traversal:
    """Merges pages into one member table; refuses pages that disagree on a member.

    Each page adds the members that are new to it, and one status document names the pages, the
    cursor and whether the frontier is complete; the newest document counts, so that older pending
    offers are superseded and a restart goes on where the last run stopped. A strict fold over an
    open frontier must wait: ``members`` says whether it is complete. A page that disagrees leaves
    nothing behind.
    """

    def __init__(self, spark: SparkSession, folder: str, identity: str, facts: list[str]):
        from ..plans.ledger import Files

        self.spark, self.folder, self.identity, self.facts = spark, folder.rstrip("/"), identity, facts
        self.files = Files(spark, self.folder)
        names = self.files.names("frontier")
        had = json.loads(self.files.read(f"frontier/{names[-1]}")) if names else {}
        self.revision, self.status = had.get("revision", 0), had.get("status", "open")
        self.pages: dict[str, str] = had.get("pages", {})
        self.cursor: str | None = had.get("cursor")

    def _offer(self) -> None:
        self.revision += 1
        text = json.dumps({"revision": self.revision, "status": self.status, "pages": self.pages, "cursor": self.cursor})
        if not self.files.create(f"frontier/{self.revision:010d}.json", text):
            raise RuntimeError("another traversal offered a frontier")

    @property
    def paths(self) -> list[str]:
        return [f"{self.folder}/{p}" for p in self.pages.values()]

    def take(self, page: DataFrame, batch_id: int = 0, cursor: str | None = None) -> None:
        """One page, idempotent by batch id; only this page is compared, with the members that earlier ones brought."""
        if str(batch_id) in self.pages:
            return
        held = self.spark.read.parquet(*self.paths) if self.pages else None
        path = f"pages/{batch_id:08d}-{uuid.uuid4().hex[:8]}"
        both = page if held is None else page.unionByName(held.join(page.select(self.identity).distinct(), self.identity, "left_semi").select(*page.columns))
        if bad := merge_pages(both, self.identity, self.facts).filter("conflict").limit(1).collect():
            raise ValueError(f"pages disagree on {bad[0][self.identity]}")
        new = page.dropDuplicates([self.identity])
        if held is not None:
            new = new.join(held.select(self.identity), self.identity, "left_anti").select(*page.columns)
        new.write.parquet(f"{self.folder}/{path}")
        self.pages[str(batch_id)] = path
        self.cursor = cursor
        self._offer()

    def finish(self) -> None:
        if self.status != "complete":
            self.status = "complete"
            self._offer()

    def members(self) -> tuple[str, DataFrame | None]:
        return self.status, self.spark.read.parquet(*self.paths) if self.pages else None

    def walk(self, load: Callable[[str | None], tuple[DataFrame, str | None]], most: int | None = None) -> str:
        """Loads pages by continuation, from the cursor that was reached, until there is none or ``most`` pages were taken."""
        taken = 0
        while self.status == "open" and (most is None or taken < most):
            page, after = load(self.cursor)
            self.take(page, len(self.pages), after)
            taken += 1
            if after is None:
                self.finish()
        return self.status

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """All available pages of a stream, one micro-batch each, then complete."""
        query = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        self.finish()

    def source(self, name: str, load: Callable[[str | None], tuple[DataFrame, str | None]], most: int | None = None) -> Source:
        """The frontier as a source of a composition: it waits while pages are missing and is final once complete."""

        def run(previous: DataFrame | None) -> DataFrame | None:
            if self.walk(load, most) != "complete":
                raise RuntimeError("the frontier is open")
            return self.members()[1]

        return Source(name, run, finality=lambda previous: self.status == "complete")


def live_counts(stream: DataFrame, kind: str, name: str, most: int = 2**53 - 1, checkpoint: str | None = None):
    """A running query that keeps saturating counts of events by kind in a memory table."""
    counts = stream.groupBy(kind).agg(F.least(F.lit(most), F.count("*")).alias("n"))
    out = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()


def windowed_counts(stream: DataFrame, at: str, kind: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event-time tumbling counts under a watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), kind).agg(F.count("*").alias("n")).select("w.start", "w.end", kind, "n")


class Observation:
    """A one-document status file with a revision, for readers in other processes."""

    def __init__(self, files):
        self.files, self.revision = files, len(files.names("observation"))

    def write(self, **fields) -> None:
        self.revision += 1
        if not self.files.create(f"observation/{self.revision:010d}.json", json.dumps({"revision": self.revision, **fields})):
            raise RuntimeError("another producer wrote the observation")

    def read(self) -> dict | None:
        names = self.files.names("observation")
        return json.loads(self.files.read(f"observation/{names[-1]}")) if names else None


def fresh_id() -> str:
    return uuid.uuid4().hex
