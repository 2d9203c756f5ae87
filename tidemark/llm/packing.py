"""Conflict-constrained best-fit packing of documents into sequences of fixed room.

Documents are dealt to shards of bounded size by a digest of their id. In a shard, bins are
kept by residual room and carry bitmaps of the sources and duplicate clusters they hold;
pieces go in by falling size, each into the tightest bin that has room and no conflict: the
search starts at the piece's own size and continues over larger residuals until a compatible
bin is found, else a new one opens. A bin takes no two pieces of one duplicate cluster and at
most ``per_source`` of one source.

Documents longer than a bin are cut into full bins and a rest. Null, empty and blank texts
have size 0, one piece, and no bin (null). A null source is a source of its own. Repeated
rows are packed each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOM, SHARD, PER_SOURCE = 2048, 4096, 2


def best_fit(sizes: list[int], sources: list, clusters: list, room: int, per_source: int = PER_SOURCE) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; pieces come in the order in which they are to be placed."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    counts: dict = {}
    for c in clusters:
        counts[c] = counts.get(c, 0) + 1
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in counts.items() if n > 1)}
    left: list[int] = []
    held: list[list[int]] = []  # source bitmaps, one for each allowed repeat
    seen: list[int] = []  # cluster bitmaps
    by_room: list[dict[int, None]] = [{} for _ in range(room + 1)]
    used = 0  # bit r: some bin has residual r
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = source_bit[source], cluster_bit.get(cluster, 0)
        found, r = -1, size
        while found < 0 and (rest := used >> r):
            r += (rest & -rest).bit_length() - 1
            found = next((b for b in by_room[r] if not seen[b] & c and not held[b][-1] & s), -1)
            r += found < 0
        if found < 0:
            found, r = len(left), room
            left.append(room)
            held.append([0] * per_source)
            seen.append(0)
        else:
            del by_room[r][found]
            if not by_room[r]:
                used ^= 1 << r
        out.append((found, room - left[found]))
        left[found] -= size
        seen[found] |= c
        for i in range(per_source):
            if not held[found][i] & s:
                held[found][i] |= s
                break
        by_room[left[found]][found] = None
        used |= 1 << left[found]
    return out


def _pack(room: int, per_source: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("piece", "ascending")])
        placed = best_fit(table.column("size").to_pylist(), table.column("source").to_pylist(), table.column("cluster").to_pylist(), room, per_source)
        shard = table.column("shard").to_numpy().astype(np.int64)
        bins = np.array([b for b, _ in placed], np.int64)
        return pa.table({"doc_id": table.column("doc_id"), "piece": table.column("piece"), "n_words": table.column("size"), "bin_id": pa.array((shard << 32) | bins), "bin_start": pa.array([o for _, o in placed], pa.int32())})

    return run


def packed(docs: DataFrame, room: int = ROOM, shard: int = SHARD, per_source: int = PER_SOURCE) -> DataFrame:
    """doc_id, piece, n_words, bin_id, bin_start of every piece of every document."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).alias("words"),
        F.xxhash64(F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))).alias("cluster"),
    )
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("words") / room).cast("int") - 1, F.lit(0)))))
    cut = cut.withColumn("size", F.least(F.lit(room), F.col("words") - F.col("piece") * room))
    shards = max(1, -(-docs.count() // shard))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(shards)))
    full = dealt.filter("size > 0").drop("words").groupBy("shard").applyInArrow(_pack(room, per_source), "doc_id long, piece int, n_words int, bin_id long, bin_start int")
    empty = cut.filter("size <= 0").select("doc_id", "piece", F.lit(0).alias("n_words"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("bin_start"))
    return full.unionByName(empty)
