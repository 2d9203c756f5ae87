"""Approximate nearest neighbours by robust-pruned directed graphs.

Distinct vectors are dealt to shards of bounded size by length, order of magnitude of their
largest component (so that no large vector blurs the others of its shard) and a digest. In
each shard a graph is grown in batches: a greedy beam search proposes neighbours, and relaxed distance pruning
keeps an edge only if no kept edge is nearer to its end by the factor alpha, so that diverse
directions stay. A shard's vectors and the blocks of queries are sorted into one task, which
builds the graph, answers block after block by beam search and lets the graph go: no graph
is moved or stored. The shards' answers merge. Inner product becomes distance by one more
coordinate; graphs are built of single-precision vectors scaled by their shard's largest
norm, scores are inner products of the original vectors in double precision.

Equal vectors are one node; of its copies the smallest ids answer. Vectors that are null,
empty, zero or hold null or non-finite components take no part, neither as query nor as
candidate, nor do rows without an id. Only vectors of equal length meet. Ties go to the
smaller id. Rows that repeat id and vector are one row; other vectors of a query's own id are
no neighbours of it, and one that would stand among its k nearest shortens its list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARD, BLOCK = 8192, 512
#: Parts into which the copies of one vector are dealt before the smallest ids of all are taken.
SALTS = 64
DEGREE, BUILD_BEAM, BEAM, ALPHA, ENTRIES = 48, 96, 192, 1.2, 24


def lifted(x: np.ndarray) -> np.ndarray:
    """One more coordinate makes all norms equal: nearest by distance is largest by inner product.

    All is divided by the largest norm, so that no square leaves the range of single precision."""
    x = unit(x.astype(np.float64), np.abs(x).max())
    norm = (x * x).sum(1)
    x = np.hstack([x, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]])
    return (x / np.sqrt(norm.max())).astype(np.float32)


def unit(x: np.ndarray, by) -> np.ndarray:
    """x / by, where by may be near the ends of the range of doubles."""
    two = 2.0 ** np.floor(np.log2(by) / 2)
    return x / two / (by / two)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, width: int, entries: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the nodes met that are nearest to each query; -1 fills up.

    ``entries``: the search also starts at nodes spread over the numbering, so that one dense
    cluster round the entry node can't hold all of the first beam.
    """
    n, m = len(x), len(q)
    norm = (x * x).sum(1)
    ids = np.full((m, width), -1, np.int32)
    dist = np.full((m, width), np.inf, np.float32)
    open_ = np.zeros((m, width), bool)
    seen = np.zeros((m, n + 1), bool)
    starts = np.unique(np.append(np.linspace(0, n - 1, min(n, ENTRIES)).astype(int), entry) if entries else [entry])[:width]
    s = len(starts)
    ids[:, :s], open_[:, :s], seen[:, n] = starts, True, True
    seen[:, starts] = True
    dist[:, :s] = norm[starts] - 2 * q @ x[starts].T
    active = np.arange(m)
    while len(active):
        slot = open_[active].argmax(1)
        node = ids[active, slot]
        open_[active, slot] = False
        near = graph[node]
        near = np.where(near < 0, n, near)
        new = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        at = np.where(new, near, 0)
        d = norm[at] - 2 * np.einsum("ard,ad->ar", x[at], q[active], optimize=False)
        d[~new] = np.inf
        all_d = np.hstack([dist[active], d])
        order = np.argsort(all_d, 1, kind="stable")[:, :width]
        dist[active] = np.take_along_axis(all_d, order, 1)
        ids[active] = np.take_along_axis(np.hstack([ids[active], np.where(new, near, -1).astype(np.int32)]), order, 1)
        open_[active] = np.take_along_axis(np.hstack([open_[active], new]), order, 1) & np.isfinite(dist[active])
        active = active[open_[active].any(1)]
    return ids, dist + (q * q).sum(1)[:, None]


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` neighbours of each node from its candidates (-1: none), nearest first, diverse."""
    alive = (cand >= 0) & (cand != nodes[:, None])
    at = np.where(alive, cand, 0)
    own = x[nodes]
    pts = x[at]
    d = ((pts - own[:, None]) ** 2).sum(2)
    d[~alive] = np.inf
    order = np.argsort(d, 1, kind="stable")
    at, d = np.take_along_axis(at, order, 1), np.take_along_axis(d, order, 1)
    pts = np.take_along_axis(pts, order[:, :, None], 1)
    alive = np.isfinite(d)
    norm = (pts * pts).sum(2)
    out = np.full((len(nodes), degree), -1, np.int32)
    row = np.arange(len(nodes))
    for k in range(degree):
        first = alive.argmax(1)
        has = alive[row, first]
        if not has.any():
            break
        out[has, k] = at[row, first][has]
        p = pts[row, first]
        gap = np.maximum(norm + norm[row, first][:, None] - 2 * np.einsum("acd,ad->ac", pts, p), 0)
        alive &= ~((alpha * alpha * gap <= d) | (at == at[row, first][:, None])) & has[:, None]
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """Adjacency (-1 fills up) and entry node. Nodes enter in random order in batches that double in size."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int32)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at, step = 1, 1
    while at < n:
        nodes = order[at : at + step]
        cand = beam_search(x, graph, entry, x[nodes], beam)[0]
        graph[nodes] = robust_prune(x, nodes, cand, degree, alpha)
        src = np.repeat(nodes, degree)
        dst = graph[nodes].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        ends, first, count = np.unique(dst, return_index=True, return_counts=True)
        for s in range(0, len(ends), 256):
            e, c = ends[s : s + 256], count[s : s + 256]
            extra = np.full((len(e), c.max()), -1, np.int32)
            extra[np.repeat(np.arange(len(e)), c), np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)] = src[first[s] : first[s] + c.sum()]
            both = np.hstack([graph[e], extra])
            full = (both >= 0).sum(1) > degree
            if full.any():
                graph[e[full]] = robust_prune(x, e[full], both[full], degree, alpha)
            if (~full).any():
                graph[e[~full]] = -np.sort(-both[~full], 1)[:, :degree]
        at += len(nodes)
        step = min(step * 2, 256)
    return graph, entry


def _block(table: pa.Table) -> pa.Table:
    """The queries of one block as one row."""
    ids = table.column("rep").to_numpy()
    x = _matrix(table.column("v").combine_chunks())
    return pa.table({"dim": pa.array([x.shape[1]], pa.int32()), "qids": pa.array([ids.tobytes()], pa.binary()), "q": pa.array([x.tobytes()], pa.binary())})


def _matrix(lists: pa.Array) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _answer(ids: np.ndarray, x: np.ndarray, points: np.ndarray, graph: np.ndarray, entry: int, qids: np.ndarray, q: np.ndarray, k: int, beam: int) -> pa.RecordBatch:
    """The k nearest nodes found of each query of a block."""
    wide = unit(q, np.abs(q).max(axis=1, keepdims=True))  # a query's length changes no order
    wide /= np.sqrt((wide * wide).sum(1, keepdims=True))
    found, _ = beam_search(points, graph, entry, np.hstack([wide, np.zeros((len(q), 1))]).astype(np.float32), max(beam, k), True)
    score = np.einsum("qcd,qd->qc", x[np.maximum(found, 0)], q)
    near = ids[np.maximum(found, 0)]
    order = np.lexsort((near, -np.where(found < 0, -np.inf, score), found < 0), axis=1)[:, :k]
    ok = (np.take_along_axis(found, order, 1) >= 0).ravel()
    near, score = np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, near.shape[1])[ok]), pa.array(near.ravel()[ok]), pa.array(score.ravel()[ok])], names=["qrep", "rep", "score"])


def _shards(k: int, beam: int):
    """Over rows sorted by shard, vectors before blocks of queries: builds each shard's graph once and answers its blocks one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, vectors, built = None, [], [], None
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            names, kinds = col["shard"].to_pylist(), col["block"].to_numpy(zero_copy_only=False)
            at = 0
            while at < len(names):
                if names[at] != shard:
                    shard, ids, vectors, built = names[at], [], [], None
                if kinds[at] < 0:
                    to = at + 1
                    while to < len(names) and names[to] == shard and kinds[to] < 0:
                        to += 1
                    ids.append(col["rep"].slice(at, to - at).to_numpy())
                    vectors.append(_matrix(col["v"].slice(at, to - at)))
                    at = to
                    continue
                if built is None:
                    order = np.argsort(np.concatenate(ids))
                    x = np.concatenate(vectors)[order]
                    points = lifted(x)
                    built = (np.concatenate(ids)[order], x, points, *build_graph(points))
                dim = built[1].shape[1]
                yield _answer(*built, np.frombuffer(col["qids"][at].as_py(), np.int64), np.frombuffer(col["q"][at].as_py(), np.float64).reshape(-1, dim), k, beam)
                at += 1

    return run


def nearest(vectors: DataFrame, k: int = 20, query_step: int = 20, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by ``query_step``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    number = "array<double>" if "double" in vectors.schema["embedding"].dataType.simpleString() else "array<float>"
    fine = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(number).alias("v"))
        .filter("vec_id is not null and v is not null and forall(v, e -> e is not null and not isnan(e) and abs(e) < double('infinity')) and exists(v, e -> e <> 0)")
        .withColumn("v", F.transform("v", lambda e: e + F.lit(0.0).cast(number[6:-1])))  # one zero
    )
    mark = [F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2")]
    band = F.floor((F.log2(F.array_max(F.transform("v", F.abs)).cast("double")) + 1) / 2).cast("int")
    nodes = scratch.table(fine.groupBy("v").agg(F.min("vec_id").alias("rep")).withColumns({"dim": F.size("v"), "band": band}), "nodes")
    members = scratch.table(fine.select("vec_id", *mark).join(nodes.select("rep", *mark), ["h1", "h2"]).select("vec_id", "rep").distinct(), "members")
    asked = members.filter(F.col("vec_id") % query_step == 0)
    if asked.isEmpty():
        return scratch.only(spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), "answers")
    plan, spans, first = [], {}, 0
    for r in nodes.groupBy("dim", "band").count().orderBy("dim", "band").collect():  # a row for each length and order of magnitude
        n = -(-r["count"] // shard)
        plan.append((r["dim"], r["band"], first, n))
        spans[r["dim"]] = (spans.get(r["dim"], (first, 0))[0], first + n - 1)
        first += n
    dealt = nodes.join(F.broadcast(spark.createDataFrame(plan, "dim int, band int, first int, n int")), ["dim", "band"])
    dealt = dealt.select((F.col("first") + F.pmod(F.xxhash64("rep"), F.col("n"))).cast("int").alias("shard"), F.lit(-1).alias("block"), "rep", "v")
    asking = scratch.table(nodes.join(asked.select("rep").distinct(), "rep"), "asking")
    n_blocks = max(1, -(-asking.count() // BLOCK))
    blocks = asking.groupBy("dim", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(n_blocks)).alias("b")).applyInArrow(_block, "dim int, qids binary, q binary")
    reach = spark.createDataFrame([(d, lo, hi) for d, (lo, hi) in spans.items()], "dim int, lo int, hi int")
    sent = blocks.join(F.broadcast(reach), "dim").select(F.explode(F.sequence("lo", "hi")).alias("shard"), F.lit(0).alias("block"), "qids", "q")
    rows = dealt.unionByName(sent, allowMissingColumns=True).select("shard", "block", "rep", "v", "qids", "q")
    found = scratch.table(
        rows.repartitionById(first, "shard").sortWithinPartitions("shard", "block").mapInArrow(_shards(k + 1, beam), "qrep long, rep long, score double"), "found"
    )
    by_rep = Window.partitionBy("qrep").orderBy(F.desc("score"), "rep")
    best = found.withColumn("r", F.row_number().over(by_rep)).filter(F.col("r") <= k + 1).drop("r")
    some = members.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    for by in (["rep", "salt"], ["rep"]):
        some = some.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).filter(F.col("r") <= k + 1).drop("r")
    by_row = Window.partitionBy("qrep").orderBy(F.desc("score"), "vec_id")
    lists = best.join(some.drop("salt"), "rep").withColumn("r", F.row_number().over(by_row)).filter(F.col("r") <= k + 1).select("qrep", "vec_id", "score", "r")
    packed = lists.groupBy("qrep").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))  # k + 1 at most
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("qrep")).join(packed, "qrep")
    kept = own.select("query_id", F.slice(F.filter("near", lambda e: e["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    out = kept.select("query_id", F.posexplode("near").alias("p", "e")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))
    return scratch.only(out, "answers")
