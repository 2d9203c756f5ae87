"""Language identification by string kernels.

The blended spectrum kernel of two texts counts the character n-grams (1 to 3, hashed) that
both have, over the root of the product of their own counts. Landmark texts span a Nyström
feature space, in which a kernel ridge regression is solved one language against the rest;
since the kernel is linear in the presence vectors, landmarks and coefficients fold into one
matrix, and texts are scored in batches by matrix products.

Null texts and texts without a letter are ``und`` with score 0; rows with a null language or
id teach nothing; without any learnable row every text is ``und``. Ties go to the first
language in alphabetical order. Of several rows of one id and language the text with the
least digest teaches, once; repeated rows are predicted each, texts of any length whole. Extra columns
never reach the operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_mod, freed, mix64, one_row_each, pieces, text_docs

#: Rows of each language to learn from at most, languages to learn at most (those with most rows), and landmarks in all.
ROWS_EACH, LANGUAGES, LANDMARKS = 600, 128, 256
BITS, ORDERS = 14, (1, 2, 3)
#: Rows whose flags are held at a time, 80 KB each.
ROWS_AT_ONCE = 256
RIDGE = 1e-2
_PLACE = mix64(np.arange(11, 11 + max(ORDERS), dtype=np.uint64)) | np.uint64(1)


def presence(col: pa.Array) -> np.ndarray:
    """Rows of 2**BITS flags: the hashed n-grams that a lower-cased text has; runs of white space count as one."""
    texts = [" ".join(t.split()) if t else "" for t in pc.utf8_lower(col).to_pylist()]
    size = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    rows = np.repeat(np.arange(len(texts)), size)
    out = np.zeros((len(texts), 1 << BITS), bool)
    for n in ORDERS:
        if len(codes) < n:
            break
        acc = np.full(len(codes) - n + 1, n, np.uint64)
        for t in range(n):
            acc += (codes[t : t + len(acc)] + np.uint64(1)) * _PLACE[t]
        whole = rows[: len(acc)] == rows[n - 1 :]
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        out[rows[: len(acc)][whole], (acc[whole] >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return out


@freed
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, limit=1 << 20):
            for at in range(0, part.num_rows, ROWS_AT_ONCE):
                some = part.slice(at, ROWS_AT_ONCE)
                bits = np.packbits(presence(some.column(1)), axis=1)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array([b.tobytes() for b in bits], pa.binary())], names=["doc_id", "lang", "bits"])


def solve(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict:
    """Nyström features over evenly drawn landmarks, then one-versus-rest kernel ridge regression."""
    langs = sorted(set(labels))
    x = bits.astype(np.float32)
    norm = np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    x /= norm
    by = [np.flatnonzero(np.array(labels) == g) for g in langs]
    mark = np.concatenate([i[np.linspace(0, len(i) - 1, min(len(i), max(1, landmarks // len(langs)))).astype(int)] for i in by])
    z = x[mark]
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = (x @ z.T).astype(np.float64) @ root
    phi = np.hstack([phi, np.ones((len(phi), 1))])
    target = np.where(np.array(labels)[:, None] == np.array(langs)[None], 1.0, -1.0)
    weight = np.concatenate([np.full(len(i), 1.0 / len(i)) for i in by])[np.argsort(np.concatenate(by))][:, None] * len(labels) / len(langs)
    reg = ridge * np.eye(phi.shape[1])
    reg[-1, -1] = 1e-9
    beta = np.linalg.solve(phi.T @ (weight * phi) / len(phi) + reg / 10, phi.T @ (weight * target) / len(phi))
    return {"langs": langs, "w": (z.T.astype(np.float64) @ (root @ beta[:-1])).astype(np.float32), "b": beta[-1].astype(np.float32)}


def train(docs: DataFrame, rows_each: int = ROWS_EACH, languages: int = LANGUAGES) -> dict:
    """The model from at most ``rows_each`` rows a language: those with the smallest digests of their id among a share of
    the ids, by another digest, that has some three times as many."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and doc_id is not null and text is not null")
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    share = most.select("lang", (F.lit(3.0 * rows_each) / F.col("count")).alias("share"))
    drawn = (F.xxhash64(F.lit(7), "doc_id") / F.lit(2.0**64) + 0.5) < F.col("share")
    ids = rows.select("lang", "doc_id").join(F.broadcast(share), "lang").filter(drawn).groupBy("lang", "doc_id").agg(F.lit(1).alias("one"))  # a few thousand a language
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).filter(F.col("r") <= rows_each).select("lang", "doc_id")
    rows = one_row_each(rows, ids, ["lang", "doc_id"])  # rows_each for each language at most
    got = rows.select("doc_id", "text", "lang").mapInArrow(_packed, "doc_id long, lang string, bits binary").toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    if not got.num_rows:
        return {"langs": [], "w": np.zeros((1 << BITS, 0), np.float32), "b": np.zeros(0, np.float32)}
    bits = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in got.column("bits").to_pylist()]), axis=1)
    return solve(bits, got.column("lang").to_pylist())


def _predict(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=1 << 20):
                lang, score = [], []
                for at in range(0, part.num_rows, ROWS_AT_ONCE):
                    col = part.column(1).slice(at, ROWS_AT_ONCE)
                    has = [bool(t) and any(map(str.isalpha, t)) for t in col.to_pylist()]
                    if not model["langs"]:
                        lang += ["und"] * len(has)
                        score += [0.0] * len(has)
                        continue
                    x = presence(col).astype(np.float32)
                    f = x @ model["w"] / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) + model["b"]
                    e = np.exp(4 * (f - f.max(1, keepdims=True)).astype(np.float64))
                    e /= e.sum(1, keepdims=True)
                    best = e.argmax(1)
                    lang += [model["langs"][i] if h else "und" for i, h in zip(best, has, strict=True)]
                    score += [float(e[r, i]) if h else 0.0 for r, (i, h) in enumerate(zip(best, has, strict=True))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    return text_docs(docs).mapInArrow(lambda it, m=model: _predict(m)(it), "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learns from rows outside the held-out fold and predicts every document."""
    model = train(docs.filter(fold_mod("doc_id", folds) != held))
    return predict(docs, model).select("doc_id", (fold_mod("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")


#: Under this share of the best language a text counts as of no known language.
LEAST_SCORE = 0.3


def keep_known(model: dict, least: float = LEAST_SCORE):
    """A mapInArrow body that keeps whole rows whose language can be told."""
    predict_rows = _predict(model)

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(batch.schema.get_field_index("text"))], names=["doc_id", "text"])
            keep = [g != "und" and s >= least for x in predict_rows(iter([two])) for g, s in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run
