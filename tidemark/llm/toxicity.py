"""Toxicity by a counterfactual-regularised linear classifier.

Features are the presence of words and of word beginnings, hashed. The loss is logistic plus
a ridge plus, for every labelled sentence that names an identity group, the squared change of
the score when the group's name is swapped for another of its kind; a neutral mention then
can't carry weight of its own.

Null and empty texts get the score of a text without features; labels that are null or name
no document teach nothing; an id labelled twice counts as often as it is labelled, and of
several texts of one id the one with the least digest teaches. Without any labelled row of both classes the score
is the share of label 1 (0 if none). Repeated rows are scored each, texts of any length whole.
Extra columns never reach the operator.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, fold_mod, freed, one_row_each, pieces, text_docs, utf8

#: Labelled rows to learn from at most, those with the smallest digest of their id.
SAMPLE_ROWS = 20_000
#: Hashed features; how many of them the model keeps; in how many sampled texts one must occur.
BUCKETS, KEPT, LEAST_TEXTS = 1 << 20, 1024, 8
#: Bytes of the word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6)
#: Groups of names that may replace one another, in English, French, German and Spanish.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual"), ("transgender", "cisgender"),
    ("immigrants", "natives"), ("disabled", "able-bodied"), ("elderly", "young"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"), ("noirs", "blancs", "asiatiques", "arabes"), ("immigrés", "autochtones"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch"), ("schwarze", "weiße", "asiaten"), ("einwanderer", "einheimische"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"), ("negros", "blancos", "asiáticos"), ("inmigrantes", "nativos"),
)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and word beginning; rows ascend, repeats stay."""
    data, off = utf8(pc.utf8_lower(col))
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    hasher = SpanHasher(data)
    rows = np.searchsorted(off, starts, side="right") - 1
    found = [hasher(starts, ends)]
    owner = [rows]
    for n in BEGINNINGS:
        fit = ends - starts >= n
        found.append(hasher(starts[fit], starts[fit] + n) ^ np.uint64(n * 0x51ED27))
        owner.append(rows[fit])
    order = np.argsort(np.concatenate(owner), kind="stable")
    return np.concatenate(owner)[order], (np.concatenate(found)[order] % np.uint64(BUCKETS)).astype(np.int64)


class Swapper:
    """Swaps every identity term for the next one of its group."""

    def __init__(self, groups=IDENTITY):
        self.next = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
        self.find = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(map(re.escape, self.next), key=len, reverse=True)) + r")(?![^\W_])", re.IGNORECASE)

    def __call__(self, text: str) -> str | None:
        """None if the text has no term."""
        out, n = self.find.subn(lambda m: self.next[m.group(0).lower()], text)
        return out if n else None


def _identity_buckets(groups) -> np.ndarray:
    terms = [t for g in groups for t in g]
    return np.unique(features(pa.array(terms))[1]) if terms else np.zeros(0, np.int64)


@freed
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each feature: texts of label 1 and of label 0 that have it."""
    pos, neg = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in pieces(batch):
            rows, bucket = features(part.column(1))
            seen = np.unique(rows * BUCKETS + bucket)
            toxic = part.column(2).to_numpy(zero_copy_only=False)[seen // BUCKETS] == 1
            pos += np.bincount(seen[toxic] % BUCKETS, minlength=BUCKETS)
            neg += np.bincount(seen[~toxic] % BUCKETS, minlength=BUCKETS)
    at = np.flatnonzero(pos + neg)
    for s in range(0, len(at), 65536):
        i = at[s : s + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(pos[i]), pa.array(neg[i])], names=["bucket", "pos", "neg"])


def _kept_features(kept: np.ndarray, groups):
    swap = Swapper(groups) if groups else None

    def own(col):
        rows, bucket = features(col)
        at = np.minimum(np.searchsorted(kept, bucket), len(kept) - 1)
        hit = kept[at] == bucket
        seen = np.unique(rows[hit] * len(kept) + at[hit])
        cut = np.searchsorted(seen // len(kept), np.arange(len(col) + 1))
        return [(seen[s:e] % len(kept)).astype(np.int32).tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)]

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                x = own(part.column(1))
                swapped = [swap(t) if swap and t else None for t in part.column(1).to_pylist()]
                y = own(pa.array(swapped, pa.string())) if any(swapped) else [None] * len(x)
                other = [b if t is not None else None for b, t in zip(y, swapped, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array(x, pa.binary()), pa.array(other, pa.binary())], names=["toxic", "x", "swapped"])

    return run


def fit(x: np.ndarray, y: np.ndarray, change: np.ndarray, ridge: float = 2e-4, fair: float = 10.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps.

    Loss: class-balanced mean logistic + ridge*|w|^2 + fair*mean((change @ w)^2).
    """
    n, m = x.shape
    p = max(y.mean(), 1e-6)
    weight = np.where(y == 1, 0.5 / p, 0.5 / max(1 - p, 1e-6)).astype(np.float32) / n
    w, b, v, c = np.zeros(m, np.float32), np.float32(0), np.zeros(m, np.float32), np.float32(0)
    k = max(len(change), 1)
    reach = 0.25 * float((weight * (1 + (x * x).sum(1))).sum()) + 2 * ridge + 2 * fair * float((change * change).sum()) / k
    step = np.float32(1 / reach)
    for i in range(rounds):
        g = weight * (1 / (1 + np.exp(-(x @ v + c))) - y)
        dw = x.T @ g + 2 * ridge * v
        if len(change):
            dw += 2 * fair / k * (change.T @ (change @ v))
        w2, b2 = v - step * dw, c - step * g.sum()
        t = np.float32(i / (i + 3))
        v, c, w, b = w2 + t * (w2 - w), b2 + t * (b2 - b), w2, b2
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS, groups=IDENTITY, fair: float = 10.0) -> dict:
    """The model: kept buckets, their weights, the intercept. ``docs`` and ``labels`` are the rows allowed for learning."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    ids = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = one_row_each(text_docs(docs), ids.select("doc_id").distinct(), ["doc_id"])
    rows = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")  # at most `sample` rows
    share = rows.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    n, p = share["n"] or 0, share["p"] or 0
    if not n or p in (0, n):
        return {"kept": np.zeros(1, np.int64), "w": np.zeros(1, np.float32), "b": 20.0 if n and p == n else -20.0}
    counts = rows.mapInArrow(_counts, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (p - F.col("pos") + 0.5)) - F.log((F.col("neg") + 0.5) / (n - p - F.col("neg") + 0.5))
    spread = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    best = counts.filter(F.col("pos") + F.col("neg") >= min(LEAST_TEXTS, n // 100 + 2)).withColumn("z", F.abs(odds / spread)).orderBy(F.desc("z"), "bucket").limit(KEPT)
    kept = np.unique(np.concatenate([np.array([r[0] for r in best.select("bucket").collect()], np.int64), _identity_buckets(groups)]))
    got = rows.mapInArrow(_kept_features(kept, groups), "toxic int, x binary, swapped binary").toArrow()
    x = np.zeros((got.num_rows, len(kept)), np.float32)
    y = got.column("toxic").to_numpy().astype(np.float32)
    change = []
    for i, (a, s) in enumerate(zip(got.column("x").to_pylist(), got.column("swapped").to_pylist(), strict=True)):
        x[i, np.frombuffer(a, np.int32)] = 1
        if s is not None:
            d = x[i].copy()
            d[np.frombuffer(s, np.int32)] -= 1
            change.append(d)
    w, b = fit(x, y, np.array(change, np.float32).reshape(-1, len(kept)), fair=fair)
    return {"kept": kept, "w": w, "b": b}


def _scores(model: dict):
    table = np.zeros(BUCKETS, np.float32)
    slot = np.zeros(BUCKETS, bool)
    table[model["kept"]], slot[model["kept"]] = model["w"], True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                rows, bucket = features(part.column(1))
                hit = slot[bucket]
                seen = np.unique(rows[hit] * BUCKETS + bucket[hit])
                z = np.bincount(seen // BUCKETS, weights=table[seen % BUCKETS], minlength=part.num_rows) + model["b"]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], names=["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    small = {k: model[k] for k in ("kept", "w", "b")}
    return text_docs(docs).mapInArrow(lambda it, m=small: _scores(m)(it), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Learns from labels outside the held-out fold and scores every document."""
    model = train(docs, labels.filter(fold_mod("doc_id", folds) != held))
    return toxicity_scores(docs, model).select(
        "doc_id", (fold_mod("doc_id", folds) == held).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def keep_below(model: dict, limit: float):
    """A mapInArrow body that keeps whole rows whose score is under the limit."""
    score = _scores({k: model[k] for k in ("kept", "w", "b")})

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(batch.schema.get_field_index("text"))], names=["doc_id", "text"])
            got = [x.column(1) for x in score(iter([two]))]
            yield batch.filter(pc.less(pa.chunked_array(got, pa.float64()).combine_chunks(), limit))

    return run
