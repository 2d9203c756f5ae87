"""Licence scans by canonical digests.

A text is normalised (case, punctuation, copyright lines, equivalent spellings, white space)
and its SHA-256 is joined to the digests of known licence texts, whole text against whole
text. Lines are looked up in the same way against known one-line notices.

Null texts match nothing, nor does a text that normalises to nothing; repeated rows are
matched each; no text is cut. All of it is DataFrame functions.
"""

from __future__ import annotations

import re
from functools import reduce
from importlib import resources
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
    "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Known texts, fixed values: whole licences and one-line notices.
KNOWN = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
)


def _variants(text: str) -> set[str]:
    """The forms in which a full text is passed on: with and without what follows its terms, with list marks or numbers, with and without its title."""
    out = {text} | {text[: m.end()] for m in re.finditer(r"END OF TERMS AND CONDITIONS", text)}
    if text.startswith("BSD "):
        marks = iter("123")
        out.add(re.sub(r"(?m)^\* ", lambda m: f"{next(marks)}. ", text))
        out |= {t.split("\n", 1)[1] for t in out}
    return out


def _full_texts() -> tuple[tuple[str, str], ...]:
    files = sorted((f for f in resources.files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return tuple((f.name.removesuffix(".txt"), t) for f in files for t in sorted(_variants(f.read_text(encoding="utf-8"))))


#: Full texts of further licences, from the files of licence_texts.
TEXTS = _full_texts()
#: Equivalent spellings: (pattern, replacement), applied in this order to the normalised text.
SPELLINGS = (
    (r"\blicenc(e|ed|es|ing)\b", "licens$1"), (r"\bsub licens", "sublicens"), (r"\bnon infringement\b", "noninfringement"),
    (r"\bnon commercial\b", "noncommercial"), (r"\borganisation", "organization"), (r"\bfavour", "favor"), (r"\bcopyright owner", "copyright holder"),
    (r"\bcreative commons attribution", "cc by"), (r"\bversion (\d)", "v $1"), (r"\bv(\d)", "v $1"), (r"\bhttps\b", "http"),
)
#: Lines that name a holder or reserve rights.
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(copyright\b|copr\b|\(c\) ?[0-9]|© ?)[^\n]*$|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"


#: Signs that are read as a space: white space, ASCII punctuation, and the marks below; a run of them is one space.
SIGNS = r"[\x00-\x20!-/:-@\[-`{-~\u00A0–—‘’“”©]+"
#: What a text has if the expression for copyright lines, or a spelling rule, can match in it at all.
_COPYRIGHT_SIGNS = ("copyright", "copr", "(c)", "©", "all rights reserved")
_SPELLING_SIGNS = ("licenc", "sub licens", "non infringement", "non commercial", "organisation", "favour", "copyright owner", "creative commons attribution", "version ", "https")


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    out = F.trim(F.regexp_replace(out, SIGNS, " "))
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return out


def with_canonical(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with ``canonical`` of a column, in steps: an expression runs only over texts that have what it looks for."""
    has = lambda c, signs: reduce(or_, (F.col(c).contains(s) for s in signs))
    out = rows.withColumn(name, F.lower(F.col(text)))
    out = out.withColumn(name, F.when(has(name, _COPYRIGHT_SIGNS), F.regexp_replace(name, COPYRIGHT, " ")).otherwise(F.col(name)))
    out = out.withColumn(name, F.trim(F.regexp_replace(name, SIGNS, " ")))
    spelled = F.col(name)
    for pattern, to in SPELLINGS:
        spelled = F.regexp_replace(spelled, pattern, to)
    return out.withColumn(name, F.when(has(name, _SPELLING_SIGNS) | F.col(name).rlike(r"\bv\d"), spelled).otherwise(F.col(name)))


def digest(text: Column) -> Column:
    """Null if nothing is left of the text."""
    return F.sha2(F.nullif(canonical(text), F.lit("")).cast("binary"), 256)


def known_digests(spark: SparkSession, known=KNOWN + TEXTS) -> DataFrame:
    """(digest, licence), one row a digest."""
    table = spark.createDataFrame([(n, t) for n, t in known], "licence string, text string")
    return table.select(digest(F.col("text")).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


#: Words that a spelling rule may make; any other word of a normalised text stands in the text as it is.
_MADE = re.compile("licens|sublicens|noninfringement|noncommercial|organi|favo|copyright|holder|cc|by|v$|http")
#: Known texts up to this number are broadcast, and looked for by word first.
FEW = 10_000


def anchors(spark: SparkSession, known) -> str | None:
    """An expression that every text matches which normalises to a known one: of each known text the longest word that no rule can make.

    None if some known text has no such word, or if they are too many to look for."""
    if len(known) > FEW:
        return None
    table = spark.createDataFrame([(t,) for _, t in known], "text string").select(canonical(F.col("text")))
    words = set()
    for (text,) in table.collect():
        sure = [w for w in text.split(" ") if w.isascii() and w.isalpha() and not _MADE.match(w)]
        if text and not sure:
            return None
        words |= {max(sure, key=lambda w: (len(w), w))} if text else set()
    return "|".join(sorted(words)) if 0 < len(words) <= 200 else None


def licences(docs: DataFrame, known=KNOWN + TEXTS) -> DataFrame:
    """doc_id, text_digest, text_licence (whole text), line_licences (sorted, comma-joined) and n_lines of every row.

    A line counts if it is the whole of a known notice; only matching lines are shuffled.
    Lines belong to their row's id and text, so that rows of one id keep their own lines.
    """
    spark = docs.sparkSession
    table = known_digests(spark, known)
    table = F.broadcast(table) if len(known) <= FEW else table
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_id", F.sha2(F.col("text").cast("binary"), 256))
    lines = rows.select("doc_id", "text_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    if (words := anchors(spark, known)) is not None:
        lines = lines.filter(F.lower("line").rlike(words))  # without these words no line can normalise to a known text
    lines = (
        lines.select("doc_id", "text_id", "place", digest(F.col("line")).alias("digest")).join(table, "digest")
        .groupBy("doc_id", "text_id").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("line_licences"), F.count_distinct("place").alias("n"))
        .withColumnsRenamed({"doc_id": "line_doc", "text_id": "line_text"})
    )
    whole = with_canonical(rows, "text", "canonical").select("doc_id", "text_id", F.sha2(F.nullif(F.col("canonical"), F.lit("")).cast("binary"), 256).alias("text_digest"))
    whole = whole.join(table.withColumnsRenamed({"digest": "text_digest", "licence": "text_licence"}), "text_digest", "left")
    out = whole.join(lines, F.col("doc_id").eqNullSafe(F.col("line_doc")) & F.col("text_id").eqNullSafe(F.col("line_text")), "left")
    return out.select("doc_id", "text_digest", "text_licence", F.coalesce("line_licences", F.lit("")).alias("line_licences"), F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"))


def _sql_canonical(x: str) -> str:
    q = lambda s: s.replace("'", "''").replace("$", "\\")
    out = f"regexp_replace(lower({x}), '{COPYRIGHT.replace(chr(39), chr(39) * 2)}', ' ', 'g')"
    out = f"trim(regexp_replace(regexp_replace({out}, '[\\x00-\\x20!-/:-@\\[-`{{-~]+', ' ', 'g'), '[ \u00A0–—‘’“”©]+', ' ', 'g'))"
    for pattern, to in SPELLINGS:
        out = f"regexp_replace({out}, '{q(pattern)}', '{q(to)}', 'g')"
    return out


def oracle_sql(known=KNOWN + TEXTS) -> str:
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in known)
    dig = lambda x: f"sha256(nullif({_sql_canonical(x)}, ''))"
    return f"""
WITH known AS (SELECT digest, min(licence) AS licence FROM (SELECT {dig("text")} AS digest, licence FROM (VALUES {rows}) AS k(licence, text)) GROUP BY digest),
lines AS (SELECT doc_id, sha256(text) AS text_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents),
hits AS (SELECT doc_id, text_id, array_to_string(list_sort(list(DISTINCT licence)), ',') AS line_licences, count(DISTINCT place) AS n
         FROM (SELECT doc_id, text_id, place, {dig("line")} AS digest FROM lines) JOIN known USING (digest) GROUP BY doc_id, text_id),
whole AS (SELECT doc_id, sha256(text) AS text_id, {dig("text")} AS text_digest FROM documents)
SELECT w.doc_id, w.text_digest, k.licence AS text_licence, coalesce(h.line_licences, '') AS line_licences, coalesce(h.n, 0)::BIGINT AS n_lines
FROM whole w LEFT JOIN known k ON k.digest = w.text_digest LEFT JOIN hits h ON h.doc_id IS NOT DISTINCT FROM w.doc_id AND h.text_id IS NOT DISTINCT FROM w.text_id"""
