"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import html, jaccard, language, licences, neighbours, packing, pieces_lattice, secrets, telephony, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


QUERIES = {
    "op1_neighbours": lambda spark, d: neighbours.nearest(_read(spark, d, "embeddings")),
    "op2_html": lambda spark, d: html.main_text(_read(spark, d, "pages")),
    "op3_jaccard": lambda spark, d: jaccard.jaccard_components(_read(spark, d, "documents")).select("doc_id", "n_shingles", "component_id"),
    "op4_licences": lambda spark, d: licences.licences(_read(spark, d, "documents")),
    "op5_toxicity": lambda spark, d: toxicity.toxicity(_read(spark, d, "documents"), _read(spark, d, "labels")),
    "op6_sentencepiece": lambda spark, d: pieces_lattice.encoded_digests(_read(spark, d, "documents")),
    "op7_language": lambda spark, d: language.languages(_read(spark, d, "documents")),
    "op8_packing": lambda spark, d: packing.packed(_read(spark, d, "documents")),
    "op9_secrets": lambda spark, d: secrets.secrets(_read(spark, d, "documents")),
    "op10_telephony": lambda spark, d: telephony.media_columns(_read(spark, d, "documents")),
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OP3 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT x, x FROM both_ways UNION SELECT r.doc_id, e.y FROM reach r JOIN both_ways e ON r.other = e.x),
least_id AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_id l USING (doc_id)"""

ORACLE_SQL = {"op3_jaccard": _OP3, "op4_licences": licences.oracle_sql()}
