"""Exact n-gram Jaccard join by parity sketches.

Every set is cut into blocks by token hash; a block's word is the XOR of its token hashes,
and a bit sketch takes one toggled bit for each token, so that the Hamming distance of two
sketches never exceeds the symmetric difference D of the sets. A link needs D <= (a+b)/7 at
similarity 0.75. Within a size band all sets use the same k blocks, at least k-D of which
agree for a link; in one global order of block words (blocks with more tokens first) the
first D+1 words of both sets then share one (pigeonhole), so only these are joined.

Copies with equal sets collapse into one node first. Small buckets yield all pairs, large
ones a star around one member; what a star leaves open is settled by comparing sketches in
tiles, across components only, until nothing is left. Every surviving pair is verified on
the whole texts. Nothing is capped: a round that holds pairs back is followed by another.

Null, empty and word-less texts have no set and link with nothing. Rows with null or repeated
ids are numbered first and joined as rows of their own; the component of a row is then the
smallest id of all rows that links reach, whichever of them carries it. An empty table gives
an empty result; other columns are not read; a text is read whole, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, freed, mix64, pieces, shrink_heaps, text_docs
from .shingles import shingle_sets

#: All pairs of a bucket up to this size are made at once; larger ones start as a star.
SMALL = 8
TILE = 1024
#: Bytes of text whose block words are packed together.
PACK_BYTES = 1 << 24
#: Block words that one bucket holds on average at most, 16 bytes each.
BUCKET_WORDS = 1 << 22
#: Bits that tell, by hash, which texts a round of checks may need; broadcast as rows of 64.
NEED_BITS = 1 << 24
_U = np.uint64


def _most(a: np.ndarray, num: int) -> np.ndarray:
    """The largest partner of a set of size a at similarity num/100."""
    return a * 100 // num


def _diff(s: np.ndarray, num: int) -> np.ndarray:
    """The largest symmetric difference of a link whose sizes add up to s."""
    return s * (100 - num) // (100 + num)


def bit_sketches(h: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Parity bits of each set, 4 bits a token or more, the number of bits a power of two."""
    n = np.diff(off)
    bits = 1 << np.ceil(np.log2(np.maximum(4 * n, 64))).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(bits)])
    row = np.repeat(np.arange(len(n)), n)
    at = start[row] + (mix64(h) & (bits[row].astype(_U) - _U(1))).astype(np.int64)
    odd = (np.bincount(at, minlength=start[-1]) & 1).astype(np.uint8)
    packed = np.packbits(odd)
    return [packed[s // 8 : e // 8].tobytes() for s, e in zip(start[:-1], start[1:], strict=True)]


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def hamming(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference; the longer sketch is folded to the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())


def block_words(h: np.ndarray, off: np.ndarray, num: int = 75) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) of the block words that each set puts into its bands."""
    n = np.diff(off)
    band = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    top = (2 << band) - 1  # the largest size of the set's own band
    own = _diff(n + np.minimum(_most(n, num), top), num)
    upper = np.where(_most(n, num) > top, _diff(n + _most(n, num), num), -1)
    out_row, out_word = [], []
    for ctx, need in ((band, own), (band + 1, upper)):
        rows = np.flatnonzero((n > 0) & (need > 0 if ctx is band else need >= 0))
        if not len(rows):
            continue
        k = _diff(2 * ((2 << ctx) - 1), num)[rows] + 8
        pick = np.repeat(np.arange(len(rows)), n[rows])
        at = np.arange(len(pick)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows]) + np.repeat(off[:-1][rows], n[rows])
        tokens = h[at]
        start = np.concatenate([[0], np.cumsum(k)])
        block = ((mix64(tokens ^ _U(0xB10C)) >> _U(32)) * k[pick].astype(_U) >> _U(32)).astype(np.int64)
        cell = start[pick] + block
        xor = np.zeros(start[-1], _U)
        np.bitwise_xor.at(xor, cell, tokens)
        size = np.minimum(np.bincount(cell, minlength=start[-1]), 4095)
        owner = np.repeat(np.arange(len(rows)), k)
        index = np.arange(start[-1]) - start[owner]
        order = np.argsort((owner << 36) | ((4095 - size) << 24) | index, kind="stable")
        rank = np.arange(start[-1]) - start[owner[order]]
        chosen = order[rank <= need[rows][owner[order]]]
        salt = mix64((ctx[rows][owner[chosen]].astype(_U) << _U(40)) | index[chosen].astype(_U))
        out_row.append(rows[owner[chosen]])
        out_word.append(mix64(xor[chosen] ^ salt))
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    return np.concatenate(out_row), np.concatenate(out_word)


def _set_keys(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    keys = []
    for salt in (0x5E7, 0xD16E57):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix64(h ^ _U(salt)), dtype=_U)])
        keys.append(mix64(sums[off[1:]] - sums[off[:-1]] + np.diff(off).astype(_U)).astype(np.int64))
    return keys[0], keys[1]


def _sets_of(width: int):
    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                h, off = shingle_sets(part.column(1), width)
                k1, k2 = _set_keys(h, off)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(off).astype(np.int64)), pa.array(k1), pa.array(k2), pa.array(bit_sketches(h, off), pa.binary())],
                    names=["doc_id", "n_shingles", "k1", "k2", "sketch"],
                )

    return run


def _packed_words(width: int, num: int, parts: int):
    """Block words dealt to ``parts`` buckets: one binary row for each bucket and pack of texts."""

    def flush(packs):
        keys = np.concatenate([p[0] for p in packs])
        base = np.cumsum([0, *(len(p[0]) for p in packs)])
        rows = np.concatenate([p[1] + b for p, b in zip(packs, base[:-1], strict=True)])
        words = np.concatenate([p[2] for p in packs])
        _, first = np.unique(keys, return_index=True)  # copies within the pack go once
        keep = np.zeros(len(keys), bool)
        keep[first] = True
        live = keep[rows]
        rows, words = rows[live], words[live]
        part = (words % _U(parts)).astype(np.int64)
        order = np.argsort(part * len(keys) + rows, kind="stable")
        part, rows, words = part[order], rows[order], words[order]
        cut = np.searchsorted(part, np.arange(parts + 1))
        ids, data = [], []
        for p in range(parts):
            s, e = cut[p], cut[p + 1]
            if s == e:
                continue
            own, count = np.unique(rows[s:e], return_counts=True)
            head = np.array([len(own), e - s], np.int64)
            short = (words[s:e] // _U(parts)).view(np.uint8).reshape(-1, 8)[:, :6]
            ids.append(p)
            data.append(head.tobytes() + keys[own].tobytes() + count.astype(np.uint32).tobytes() + np.ascontiguousarray(short).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(data, pa.binary())], names=["part", "packed"])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, held = [], 0
        for batch in batches:
            for part in pieces(batch):
                h, off = shingle_sets(part.column(1), width)
                rows, words = block_words(h, off, num)
                packs.append((_set_keys(h, off)[0], rows, words))
                held += len(words) * 12
                if held > PACK_BYTES:
                    yield flush(packs)
                    packs, held = [], 0
        if packs:
            yield flush(packs)

    return run


def _runs(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of equal values."""
    start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    return start, np.diff(np.concatenate([start, [len(word)]]))


@freed
def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of set keys (kind 0), and the members of large buckets (kind 1)."""
    words, keys = [], []
    for batch in batches:
        parts = batch.column(0).to_numpy(zero_copy_only=False)
        for p, raw in zip(parts, batch.column(1), strict=True):
            raw = raw.as_py()
            m, e = np.frombuffer(raw, np.int64, 2)
            k = np.frombuffer(raw, np.int64, m, 16)
            count = np.frombuffer(raw, np.uint32, m, 16 + 8 * m)
            short = np.frombuffer(raw, np.uint8, 6 * e, 16 + 12 * m).reshape(-1, 6)
            word = np.zeros((e, 8), np.uint8)
            word[:, :6] = short
            words.append(word.view(_U).ravel() ^ (_U(p) << _U(48)))
            keys.append(np.repeat(k, count))
    names = ["kind", "a", "b"]
    if not words:
        return
    word, key = np.concatenate(words), np.concatenate(keys)
    del words, keys
    order = np.argsort(word)
    word, key = word[order], key[order]
    start, size = _runs(word)
    live = np.repeat(size > 1, size)
    word, key = word[live], key[live]
    order = np.lexsort((key, word))
    word, key = word[order], key[order]
    if len(word):
        keep = np.concatenate([[True], (word[1:] != word[:-1]) | (key[1:] != key[:-1])])
        word, key = word[keep], key[keep]
    start, size = _runs(word)
    a, b = [], []
    for d in range(1, SMALL):
        s, m = start[(size > d) & (size <= SMALL)], size[(size > d) & (size <= SMALL)]
        left = np.repeat(s, m - d) + np.arange((m - d).sum()) - np.repeat(np.cumsum(m - d) - (m - d), m - d)
        a.append(key[left])
        b.append(key[left + d])
    big = np.repeat(size > SMALL, size)
    head = np.repeat(key[start], size)
    star = big & (head != key)
    a.append(head[star])
    b.append(key[star])
    a, b = np.concatenate(a), np.concatenate(b)
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    for kind, x, y in ((0, pair[:, 0], pair[:, 1]), (1, word[big].view(np.int64), key[big])):
        for at in range(0, len(x), 65536):
            x1, y1 = x[at : at + 65536], y[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x1), kind, np.int32)), pa.array(x1), pa.array(y1)], names=names)


def _sketch_filter(num: int):
    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            sx, sy = batch.column(at["sx"]).to_pylist(), batch.column(at["sy"]).to_pylist()
            most = _diff(batch.column(at["nx"]).to_numpy() + batch.column(at["ny"]).to_numpy(), num)
            keep = [hamming(p, q) <= d for p, q, d in zip(sx, sy, most, strict=True)]
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(width: int, num: int):
    """Keeps the pairs whose whole texts have 100*intersection >= num*union."""

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "ty", 1 << 20):
                h, off = shingle_sets(part.column(part.schema.get_field_index("tx")), width)
                g, end = shingle_sets(part.column(part.schema.get_field_index("ty")), width)
                keep = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    x, y = h[off[i] : off[i + 1]], g[end[i] : end[i + 1]]
                    both = np.concatenate([x, y])
                    both.sort()
                    inter = int((both[1:] == both[:-1]).sum())
                    keep[i] = inter > 0 and 100 * inter >= num * (len(both) - inter)
                yield part.select(["x", "y"]).filter(pa.array(keep))

    return run


def _needed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among ``ids`` (id), and some others whose hash agrees, for a join that is exact.

    Texts and sketches that no pair or run names are so hardly ever shuffled. However many ids there are, the broadcast has NEED_BITS / 64 rows at most."""

    def placed(df: DataFrame, column: str) -> DataFrame:
        at = F.pmod(F.xxhash64(column), F.lit(NEED_BITS).cast("long"))
        return df.withColumns({"_place": F.shiftright(at, 6), "_bit": at.bitwiseAND(63).cast("int")})

    masks = placed(ids, "id").groupBy("_place").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_mask"))
    return placed(docs, "doc_id").join(F.broadcast(masks), "_place").filter("getbit(_mask, _bit) = 1").select(*docs.columns)


def _one_tile(num: int, most_each: int, t, u: int, w: int, node, label, n, sketch) -> tuple[np.ndarray, bool]:
    """Pairs of one tile across components that the sketches let pass, the nearest ``most_each`` of each component, and whether more are left."""
    size = min(map(len, sketch))
    bits = np.stack([_fold(np.frombuffer(s, np.uint8), size) for s in sketch]).view(_U)
    left, right = np.flatnonzero(t == u), np.flatnonzero(t == w)
    found = []
    step = max(1, (1 << 21) // max(1, len(right) * bits.shape[1]))
    for at in range(0, len(left), step):
        i = left[at : at + step]
        d = np.bitwise_count(bits[i][:, None] ^ bits[right][None]).sum(2, dtype=np.int64)
        a, b = n[i][:, None], n[right][None]
        ok = (d <= _diff(a + b, num)) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * num) & (label[i][:, None] != label[right][None])
        p, q = np.nonzero(ok)
        if len(p):
            found.append(np.stack([i[p], right[q], d[p, q]], 1))
    if not found:
        return np.zeros((0, 2), np.int64), False
    p, q, d = np.concatenate(found).T
    near = np.zeros(len(p), bool)
    for side in (p, q):
        order = np.lexsort((d, label[side]))
        s, m = _runs(label[side][order])
        near[order[np.arange(len(p)) - np.repeat(s, m) < most_each]] = True
    x, y = node[p[near]], node[q[near]]
    return np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0), bool(len(near) > near.sum())


def _tile_pairs(num: int, most_each: int):
    """Over rows sorted by (run, u, w): pairs (x, y) of every tile, and (null, run) where a tile holds pairs back."""

    def done(table: pa.Table, pairs: list, held: list) -> None:
        col = {c: table.column(c).to_numpy() for c in ("run", "t", "u", "w", "node", "label", "n")}
        sketch = table.column("sketch").to_pylist()
        new = np.flatnonzero(np.concatenate([[True], (col["run"][1:] != col["run"][:-1]) | (col["u"][1:] != col["u"][:-1]) | (col["w"][1:] != col["w"][:-1])]))
        for s, e in zip(new, [*new[1:], len(sketch)], strict=True):
            got, more = _one_tile(num, most_each, col["t"][s:e], col["u"][s], col["w"][s], col["node"][s:e], col["label"][s:e], col["n"][s:e], sketch[s:e])
            if len(got):
                pairs.append(got)
            if more:
                held.append(col["run"][s])

    def told(pairs: list, held: list) -> pa.RecordBatch:
        xy = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *pairs]), axis=0)
        runs = np.unique(np.array(held, np.int64))
        x = pa.array(np.concatenate([xy[:, 0], np.zeros(len(runs), np.int64)]), mask=np.arange(len(xy) + len(runs)) >= len(xy))
        return pa.RecordBatch.from_arrays([x, pa.array(np.concatenate([xy[:, 1], runs]))], names=["x", "y"])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, pairs, held = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            r, u, w = (table.column(c).to_numpy() for c in ("run", "u", "w"))
            last = np.flatnonzero((r != r[-1]) | (u != u[-1]) | (w != w[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                done(table.slice(0, cut), pairs, held)
            rest = table.slice(cut)
            if sum(map(len, pairs)) > 1 << 20:
                yield told(pairs, held)
                pairs, held = [], []
        if rest is not None and rest.num_rows:
            done(rest, pairs, held)
        yield told(pairs, held)

    return run


def connected_labels(scratch: Scratch, edges: DataFrame, tag: str) -> DataFrame:
    """(node, label): the least node reachable, by neighbour minima and pointer jumping over tables."""
    both = scratch.table(edges.select("x", "y").union(edges.select(F.col("y"), F.col("x"))).distinct(), f"{tag}-both")
    labels = scratch.table(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")), f"{tag}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        new = labels.join(near, F.col("node") == F.col("x")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = new.join(jump, F.col("label") == F.col("via"), "left").select("node", "was", F.coalesce("far", "label").alias("label"))
        table = scratch.table(new, f"{tag}-{step}")
        done = table.filter("was <> label").isEmpty()
        scratch.drop(f"{tag}-{step - 1}")
        labels = table.select("node", "label")
        if done:
            scratch.drop(f"{tag}-both")
            return labels


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and n_links of each row.

    n_links counts the verified links of the row's distinct set that the join had to look at;
    links between copies and links inside an already joined component are not all expanded.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = text_docs(docs)
    once = rows.select("doc_id").groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty()
    if once:
        return scratch.only(_components(scratch, rows, width, percent), "components")
    numbered = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = scratch.table(_components(scratch, numbered.select(F.col("row").alias("doc_id"), "text"), width, percent), "rows")
    out = numbered.select("doc_id", "row").join(found.withColumnsRenamed({"doc_id": "row", "component_id": "group"}), "row")
    least = out.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return scratch.only(out.join(least, "group").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "n_links"), "components")


def _components(scratch: Scratch, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``jaccard_components`` of rows (doc_id, text) whose ids are unique."""
    spark = docs.sparkSession
    sets = scratch.table(docs.mapInArrow(_sets_of(width), "doc_id long, n_shingles long, k1 long, k2 long, sketch binary"), "sets")
    nodes = scratch.table(
        sets.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n")), "nodes"
    )
    # a set of n shingles puts two thirds of n words into buckets at most, in both of its bands together
    words = nodes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * words // (3 * BUCKET_WORDS)))
    packed = docs.mapInArrow(_packed_words(width, percent, parts), "part int, packed binary")
    found = scratch.table(packed.repartitionById(parts, F.col("part")).mapInArrow(_bucket_pairs, "kind int, a long, b long"), "found")
    shrink_heaps(spark)

    na = nodes.select(F.col("k1").alias("a"), F.col("node").alias("p"), F.col("n").alias("np"))
    nb = nodes.select(F.col("k1").alias("b"), F.col("node").alias("q"), F.col("n").alias("nq"))
    pairs = (
        found.filter("kind = 0").select("a", "b").distinct().join(na, "a").join(nb, "b")
        .filter(f"p <> q and least(np, nq) * 100 >= greatest(np, nq) * {percent}")
        .select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), F.expr("np + nq").alias("s")).distinct()
    )
    sx = sets.select(F.col("doc_id").alias("x"), F.col("sketch").alias("sx"), F.col("n_shingles").alias("nx"))
    sy = sets.select(F.col("doc_id").alias("y"), F.col("sketch").alias("sy"), F.col("n_shingles").alias("ny"))
    passed = pairs.select("x", "y").join(sx, "x").join(sy, "y").mapInArrow(_sketch_filter(percent), "x long, y long").distinct()
    tried = scratch.table(passed, "tried-0")
    shrink_heaps(spark)

    def check(p: DataFrame) -> DataFrame:
        some = _needed(docs, p.select(F.explode(F.array("x", "y")).alias("id")))
        tx = some.select(F.col("doc_id").alias("x"), F.col("text").alias("tx"))
        ty = some.select(F.col("doc_id").alias("y"), F.col("text").alias("ty"))
        return p.join(ty, "y").join(tx, "x").mapInArrow(_verify(width, percent), "x long, y long").distinct()

    links = scratch.table(check(tried), "links-0")
    labels = connected_labels(scratch, links, "cc-0")

    members = found.filter("kind = 1").select(F.col("a").alias("run"), F.col("b").alias("k1")).join(nodes, "k1").select("run", "node", "n")
    shape = members.groupBy("run").agg(F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("total"))
    alone = shape.groupBy("m", "total").agg(F.min("run").alias("run"))
    members = scratch.table(members.join(alone.select("run", "m"), "run"), "members")
    step, each = 0, 2
    while True:
        step += 1
        shrink_heaps(spark)
        now = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = now.groupBy("run").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("run")
        tiles = F.ceil(F.col("m") / TILE).cast("int")
        tile = (
            now.join(mixed, "run").withColumn("tiles", tiles).withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
            .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .select("run", "node", "label", "n", "t", F.least("t", "o").alias("u"), F.greatest("t", "o").alias("w"))
            .join(_needed(sets.select("doc_id", "sketch"), members.select(F.col("node").alias("id"))).withColumnRenamed("doc_id", "node"), "node")
            .repartition("run", "u", "w").sortWithinPartitions("run", "u", "w")
        )
        got = scratch.table(tile.mapInArrow(_tile_pairs(percent, each), "x long, y long").distinct(), f"tiles-{step}")
        fresh = scratch.table(got.filter("x is not null").join(tried, ["x", "y"], "left_anti"), f"tried-{step}")
        new = scratch.table(check(fresh), f"links-{step}")
        tried = tried.union(fresh)
        if not new.isEmpty():
            links = links.union(new)
            labels = connected_labels(scratch, links, f"cc-{step}")
        held = got.filter("x is null").select(F.col("y").alias("run"))
        if held.isEmpty():
            break  # every pair across components that the sketches let pass has been verified
        members = scratch.table(members.join(held, "run", "left_semi"), f"members-{step}")
        each *= 8
    degree = links.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    final = nodes.join(labels, "node", "left").join(degree, "node", "left").select("k1", "k2", F.coalesce("label", "node").alias("c"), "n_links")
    out = sets.join(final, ["k1", "k2"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )
    return out
