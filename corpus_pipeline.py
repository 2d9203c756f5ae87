"""Corpus pipeline: toxicity, language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of documents,
whatever else those are called. An empty table stays empty. Null ids, sources, languages and
labels are values like others; a null or empty text isn't toxic, but no language can be told
of it, so that it goes at the second stage. From the first stage on the session's batches
are held to common.BATCH_BYTES and common.COLUMN_ROWS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, language, packing, secrets, toxicity
from tidemark.llm.common import Scratch, fold_mod, shrink_heaps, small_batches

#: Tables that a stage's result still reads; run() drops them once the result is written.
LEFT: list[Scratch] = []
#: A text goes if its toxicity score is at least this.
TOXIC = 0.5


def _lean(spark: SparkSession) -> None:
    """Before each stage: what earlier ones left in the heaps goes, and batches are small."""
    small_batches(spark)
    shrink_heaps(spark)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents; the model learns from labels outside the held-out fold. Repeated rows are judged each, a score of just the limit goes."""
    _lean(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold_mod("doc_id", 5) != 0)
    model = toxicity.train(docs, labels)
    shrink_heaps(spark)
    return docs.mapInArrow(toxicity.keep_below(model, TOXIC), docs.schema)


def language_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language can be told: no letter, or hardly any evidence. The language learned of a row
    that repeats is learned once; without any row to learn from all go."""
    _lean(spark)
    model = language.train(docs.filter(fold_mod("doc_id", 4) != 2))
    shrink_heaps(spark)
    return docs.mapInArrow(language.keep_known(model), docs.schema)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group linked by shingle similarity: the one with the smallest id, any id before none.

    Rows are numbered first, so that null and repeated ids are rows like others. Texts
    without words link with nothing and stay.
    """
    _lean(spark)
    row = next(n for n in (f"row{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    scratch = Scratch(spark, "near_copies")
    LEFT.append(scratch)
    numbered = scratch.table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = jaccard.jaccard_components(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("kept_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    ids = numbered.select(row, "doc_id")
    kept = ids.join(groups, ids[row] == groups["kept_row"]).groupBy("component_id").agg(F.min_by(row, order).alias(row))
    return numbered.join(kept.select(row), row, "left_semi").select(*docs.columns)


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts, each chain of overlapping ones by one mark; n_chars follows, null for a null text."""
    _lean(spark)
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the kept documents to bins of fixed room; equal sizes go by id, and a row that repeats is packed each time."""
    _lean(spark)
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("language", language_known),
    ("near_copies", one_of_near_copies),
    ("secrets", secrets_redacted),
    ("packing", best_fit_packed),
]

#: Model scores and sequential packing have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        while LEFT:
            LEFT.pop().drop()
        if before:
            scratch.drop(before)
        before = name
    return docs
