"""SentencePiece encoding and decoding as a relational lattice.

The words that a task meets for the first time are cut into their substrings of bounded
length, the substrings are equi-joined to the piece table, the edges found are grouped by
word, and Spark's higher-order ``aggregate`` folds each word's lattice in the same task, so
that no word is shuffled; the task keeps what it has encoded for later blocks
(``encode_words`` explodes, joins, groups and folds a table of words as relations). The fold
is Viterbi for tables of log-probabilities or, for
tables whose scores are merge ranks (BPE models), replays merges over the same edges,
since the best sum of ranks is not what such a model encodes. Characters without a piece
fall back to byte pieces. Words never share pieces: no piece continues after a space mark or
over a line feed. No word is cut: words of more than ``LONGEST`` characters are merged by a
queue in the worker that finds the edges, since the fold over a lattice takes the square of a
word's length and more.

Null texts have no tokens, as empty ones have; repeated rows are encoded each. U+2581 in a
text decodes to a space, as in the library.
"""

from __future__ import annotations

import heapq
import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces as cut_batch
from .common import text_docs

#: The longest word whose lattice Spark folds.
LONGEST = 512
MODEL = os.environ.get("TIDEMARK_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"


def piece_table(spark: SparkSession, path: str = MODEL) -> DataFrame:
    """(piece, id, score) of the ordinary pieces; byte pieces have the piece ``<0xNN>`` and a null score."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(m.id_to_piece(i), i, None if m.is_byte(i) else m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i))]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def split_words(text: Column) -> Column:
    """The words of a text, space marks in front; together they are the marked text."""
    marked = F.concat(F.lit(SPACE), F.translate(text, " ", SPACE))
    words = F.split(marked, rf"(?<=[^{SPACE}])(?={SPACE})|(?<=\n)|(?=\n)")
    return F.when(F.length(text) > 0, F.filter(words, lambda w: w != "")).otherwise(F.array().cast("array<string>"))


def lattice(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(word, edges): all occurrences of pieces in each word as (end, start, score, id), by end and start."""
    longest = pieces.filter("score is not null").agg(F.max(F.length("piece"))).first()[0] or 1
    cut = F.expr(
        f"flatten(transform(sequence(0, length(word) - 1), s -> transform(sequence(1, least({longest}, length(word) - s)), "
        "l -> named_struct('start', s, 'end', s + l, 'piece', substring(word, s + 1, l)))))"
    )
    table = F.broadcast(pieces.filter("score is not null"))  # the vocabulary: tens of thousands of rows
    edges = words.filter("length(word) > 0").select("word", F.explode(cut).alias("x")).select("word", "x.*").join(table, "piece")
    grouped = edges.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("end", "start", "score", "id"))).alias("edges"))
    return words.join(grouped, "word", "left").select("word", F.coalesce("edges", F.expr("cast(array() as array<struct<end:int,start:int,score:double,id:int>>)")).alias("edges"))


#: Boundaries after all merges: each step removes the boundary inside the best edge that spans two neighbours.
_MERGES = """aggregate(
  sequence(1, length(word)), transform(sequence(0, length(word)), i -> i),
  (cuts, step) -> coalesce(array_remove(cuts, array_max(transform(
    filter(filter(edges, e -> e.end - e.start > 1), e -> array_position(cuts, e.start) > 0 and array_position(cuts, e.end) = array_position(cuts, e.start) + 2),
    e -> named_struct('score', e.score, 'left', -e.start, 'cut', cuts[cast(array_position(cuts, e.start) as int)]))).cut), cuts))"""

#: Best path: for each end the best (score, start); characters without a piece cost ``unknown``.
_VITERBI = """aggregate(
  sequence(1, length(word)), array(named_struct('score', cast(0 as double), 'start', -1)),
  (best, at) -> concat(best, array(array_max(concat(
    transform(filter(edges, e -> e.end = at), e -> named_struct('score', best[e.start].score + e.score, 'start', -e.start)),
    if(exists(edges, e -> e.end = at and e.start = at - 1), cast(array() as array<struct<score:double,start:int>>),
       array(named_struct('score', best[at - 1].score + {unknown}, 'start', 1 - at))))))),
  best -> aggregate(sequence(1, length(word)), array(length(word)),
    (cuts, step) -> if(cuts[0] = 0, cuts, concat(array(-best[cuts[0]].start), cuts))))"""

_IDS = """flatten(transform(sequence(1, size(cuts) - 1), i -> coalesce(
  array(filter(edges, e -> e.start = cuts[i - 1] and e.end = cuts[i])[0].id),
  transform(sequence(1, octet_length(substring(word, cuts[i - 1] + 1, cuts[i] - cuts[i - 1]))),
    k -> {first_byte} + cast(conv(substring(hex(encode(substring(word, cuts[i - 1] + 1, cuts[i] - cuts[i - 1]), 'UTF-8')), 2 * k - 1, 2), 16, 10) as int)))))"""


def encode_words(words: DataFrame, pieces: DataFrame, kind: str = "bpe") -> DataFrame:
    """(word, ids) of distinct words."""
    first_byte = pieces.filter("piece = '<0x00>'").first()["id"]
    if kind == "unigram":
        low = pieces.agg(F.min("score")).first()[0]
        fold = _VITERBI.format(unknown=f"cast({low - 10.0!r} as double)")
    else:
        fold = _MERGES
    ids = _IDS.format(first_byte=first_byte).replace("array(filter(edges, e -> e.start = cuts[i - 1] and e.end = cuts[i])[0].id)", "nullif(transform(filter(edges, e -> e.start = cuts[i - 1] and e.end = cuts[i]), e -> e.id), cast(array() as array<int>))")
    once = f"transform(array({fold}), cuts -> {ids})[0]"  # binds the fold's result; a column would be inlined at each use
    return lattice(words, pieces).select("word", F.expr(once).alias("ids"))


def decode_words(encoded: DataFrame, pieces: DataFrame) -> DataFrame:
    """(word, ids, decoded): ids joined back to pieces, byte pieces to bytes, in order."""
    raw = F.when(F.col("score").isNull(), F.substring("piece", 4, 2)).otherwise(F.hex(F.encode("piece", "UTF-8")))
    table = F.broadcast(pieces.select("id", raw.alias("raw")))
    parts = encoded.select("word", F.posexplode("ids").alias("p", "id")).join(table, "id")
    text = parts.groupBy("word").agg(F.decode(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "raw"))), lambda x: x["raw"]), "")), "UTF-8").alias("decoded"))
    return encoded.join(text, "word")


#: Bytes of text that are read as one block.
BLOCK_BYTES = 1 << 18
#: Distinct words that a task keeps encoded; beyond them it forgets all and begins anew.
KEPT_WORDS = 1 << 18

#: A word as ``edges_of`` gives it: n (characters) and merges, the edges of several characters, best first: key
#: (rank, id, start and end in 20, 20, 10 and 10 bits), span (a bit for each boundary from start to end; 0 in words
#: over ``BITS``), ends (the bits of the two), and watched (a better edge has one of the ends and spans this edge);
#: ids, of a word over ``LONGEST`` alone, in place of these.
_WORD_TYPE = "struct<word string, n bigint, merges array<struct<key bigint, span bigint, ends bigint, watched boolean>>, ids array<int>>"
_BLOCK = f"words array<{_WORD_TYPE}>, docs array<struct<doc_id bigint, at array<int>>>, known int"

#: The longest word whose boundaries fit a long.
BITS = 61

_WORD = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


def words_of(text: str | None) -> list[str]:
    """``split_words`` of one text."""
    if not text:
        return []
    return _WORD.findall(SPACE + text.replace(" ", SPACE))


def block_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Where each text's words end, the distinct words, and which of them each word is."""
    if pc.any(pc.match_substring(texts, "\0")).as_py():  # the sign that parts words below
        found = [words_of(t) for t in texts.to_pylist()]
        flat = pa.array([w for f in found for w in f], pa.string())
        ends = np.cumsum([0, *map(len, found)])
    else:
        marked = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(SPACE, texts, ""))
        for old, new in ((" ", SPACE), (SPACE, "\0" + SPACE), (SPACE + "\0", SPACE), ("\n", "\0\n\0")):
            marked = pc.replace_substring(marked, old, new)
        lists = pc.split_pattern(pc.fill_null(marked, ""), "\0")
        flat = lists.flatten()
        full = pc.not_equal(flat, "")
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=full.to_numpy(zero_copy_only=False), minlength=len(lists)))]).astype(np.int64)
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    return ends, coded.dictionary.to_pylist(), coded.indices.to_numpy()


def merged(word: str, ranks: dict[str, int], ids: dict[str, int], first_byte: int) -> list[int]:
    """Ids of one word of any length: the best of all pairs of neighbours that spell a piece is merged until there is none.

    A queued pair that another merge has changed no longer spells the piece of its rank."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # starts of the neighbours; after is 0 within a symbol
    queue = [r << 32 | i for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        rank, i = divmod(heapq.heappop(queue), 1 << 32)
        middle = after[i]
        if not middle or middle == n or ranks.get(word[i : after[middle]]) != rank:
            continue
        end = after[i] = after[middle]
        after[middle] = 0
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : after[end]])) is not None:
                heapq.heappush(queue, r << 32 | i)
        if i and (r := ranks.get(word[before[i] : end])) is not None:
            heapq.heappush(queue, r << 32 | before[i])
    out, i = [], 0
    while i < n:
        symbol = word[i : after[i]]
        out.extend([ids[symbol]] if symbol in ids else [first_byte + b for b in symbol.encode()])
        i = after[i]
    return out


_STEP = np.uint64(0x5851F42D4C957F2D)


class PieceHash:
    """Hashes of the ordinary pieces and of their beginnings by length: sorted, with the places of pieces, code points, ids and ranks."""

    def __init__(self, rows: list[tuple[str, int, float]]):
        found = {p: (i, k) for k, (p, i, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])))}
        self.by_length = []
        for length in range(1, max(map(len, found), default=0) + 1):
            some = sorted({p[:length] for p in found if len(p) >= length})
            points = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).reshape(len(some), length)
            hashes = np.zeros(len(some), np.uint64)
            for k in range(length):
                hashes = hashes * _STEP + points[:, k].astype(np.uint64) + np.uint64(1)
            order = np.argsort(hashes, kind="stable")
            if len(np.unique(hashes)) < len(hashes):
                raise ValueError("two pieces share a hash")
            ids, ranks = (np.array([found.get(p, (-1, -1))[k] for p in some], np.int64)[order] for k in (0, 1))
            self.by_length.append((length, hashes[order], points[order], ids, ranks))


_built: dict[int, PieceHash] = {}


def piece_hash(rows: list[tuple[str, int, float]]) -> PieceHash:
    """The table of these rows; a worker keeps the last one for its next tasks."""
    key = hash(tuple(rows))
    if key not in _built:
        table = PieceHash(rows)
        _built.clear()
        _built[key] = table
    return _built[key]


def edges_of(words: list[str], table: PieceHash) -> pa.Array:
    """The lattice of each word: its substrings of bounded length joined to the piece table, grouped by word.

    A substring that no piece begins with is not made longer."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate([[0], np.cumsum(sizes)])
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = first[owner + 1] - np.arange(len(points))
    keys, owners = [], []
    at = np.arange(len(points))
    hashes = np.zeros(len(points), np.uint64)
    for size, known, spelled, ids, ranks in table.by_length:
        keep = left[at] >= size  # the substrings grow by a character; those past their word's end go
        at, hashes = at[keep], hashes[keep]
        hashes = hashes * _STEP + points[at + (size - 1)].astype(np.uint64) + np.uint64(1)
        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        keep = known[place] == hashes
        at, hashes, place = at[keep], hashes[keep], place[keep]
        keep = (points[at[:, None] + np.arange(size)] == spelled[place]).all(axis=1)
        at, hashes, place = at[keep], hashes[keep], place[keep]
        hit = ids[place] >= 0
        start, place = at[hit], place[hit]
        if size > 1:
            word = owner[start]
            begin = start - first[word]
            keys.append(ranks[place] << 40 | ids[place] << 20 | begin << 10 | (begin + size))
            owners.append(word)
    keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owners << 30 | keys >> 40 << 10 | keys >> 10 & 1023, kind="stable")
    keys, owners = keys[order], owners[order]
    some = _possible(first[owners] + (keys >> 10 & 1023), (keys & 1023) - (keys >> 10 & 1023), len(points), len(table.by_length))
    keys, owners = keys[some], owners[some]
    ends = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(words)))])
    begin, end = keys >> 10 & 1023, keys & 1023
    short = sizes[owners] <= BITS
    low, high = np.where(short, begin, 0), np.where(short, end, 0)
    marks = np.where(short, 1 << low | 1 << high, 0)
    merges = pa.StructArray.from_arrays(
        [pa.array(keys), pa.array(np.where(short, (1 << high - low) - 1 << low | marks, 0)), pa.array(marks), pa.array(_watched(keys, owners, begin, end))],
        ["key", "span", "ends", "watched"],
    )
    return pa.StructArray.from_arrays(
        [
            pa.array(words, pa.string()), pa.array(sizes),
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), merges),
        ],
        ["word", "n", "merges"],
    )


def _possible(start: np.ndarray, size: np.ndarray, n: int, longest: int) -> np.ndarray:
    """Places of the edges that some merge may make; the others are never open, so that no fold is changed without them.

    Edges come by word, best first. A pair of characters that is better than every other edge that begins or ends
    between them is merged before any of those, whatever comes first; and an edge needs two parts that are
    characters or possible edges. What two rounds leave is left to the fold."""
    at = np.arange(len(start))
    for _ in range(2):
        best = np.full(n + 1, len(start))
        for touched in (start, start + size):
            once = np.full(n + 1, len(start))
            once[touched[at[::-1]]] = at[::-1]  # the last one written, the best, stays
            best = np.minimum(best, once)
        pair = at[size[at] == 2]
        shut = np.zeros(n + 1, bool)
        shut[start[pair][pair < best[start[pair] + 1]] + 1] = True
        left = at[~(shut[start[at]] | shut[start[at] + size[at]])]
        made = np.zeros((longest + 1, n + 1), bool)
        made[1] = True
        by_size = left[np.argsort(size[left], kind="stable")]
        to = np.searchsorted(size[by_size], np.arange(longest + 2))
        for length in range(2, longest + 1):
            begin = start[by_size[to[length] : to[length + 1]]]
            found = np.zeros(len(begin), bool)
            for part in range(1, length):
                found |= made[part][begin] & made[length - part][begin + part]
            made[length][begin[found]] = True
        at = left[made[size[left], start[left]]]
    return at


def _watched(keys: np.ndarray, owners: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a better edge of the same word shares the start and ends later, or shares the end and starts earlier."""
    out = np.zeros(len(keys), bool)
    for shared, reach in ((begin, 1023 - end), (end, begin)):
        group = owners << 10 | shared
        order = np.argsort(group << 10 | reach, kind="stable")  # in a group, wider edges come first
        group, rank = group[order], keys[order]
        new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        for back in range(1, int(np.diff(np.append(new, len(group))).max(initial=1))):
            out[order[back:]] |= (group[back:] == group[:-back]) & (rank[:-back] < rank[back:])
    return out


class _Places(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = place = len(self)
        return place


def blocks(pieces: DataFrame, first_byte: int, common: list[str], kept: int = KEPT_WORDS):
    """Function for mapInArrow: a row for each block of documents, with the words that its task has not met before and
    their edges, each document as places among all words met, and how many of those earlier blocks have brought."""
    rows = [(r.piece, r.id, r.score) for r in pieces.filter("score is not null").collect()]  # the vocabulary: tens of thousands of rows

    def run(batches):
        pool = pa.default_memory_pool()  # keeps what it has freed unless told
        table = piece_hash(rows)
        ids = {p: i for p, i, _ in rows}
        ranks = {p: k for k, (p, _, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])))}
        start = {w: i for i, w in enumerate(common)}
        seen = _Places(start)
        for batch in batches:
            for part in cut_batch(batch, limit=BLOCK_BYTES):
                if len(seen) - len(start) > kept:
                    seen = _Places(start)
                known = len(seen)
                ends, distinct, of = block_words(part.column(1))
                places = np.fromiter(map(seen.__getitem__, distinct), np.int32, len(distinct))
                at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places[of]))
                docs = pa.StructArray.from_arrays([part.column(0), at], ["doc_id", "at"])
                fresh = list(islice(reversed(seen), len(seen) - known))[::-1]
                longer = pa.nulls(len(fresh), pa.list_(pa.int32()))
                if max(map(len, fresh), default=0) > LONGEST:
                    longer = pa.array([merged(w, ranks, ids, first_byte) if len(w) > LONGEST else None for w in fresh], pa.list_(pa.int32()))
                    fresh = [w if len(w) <= LONGEST else "" for w in fresh]
                words = edges_of(fresh, table)
                words = pa.StructArray.from_arrays([*words.flatten(), longer], [*(f.name for f in words.type), "ids"])
                columns = [words, docs]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([known], pa.int32())], ["words", "docs", "known"])
                pool.release_unused()

    return run


_START, _END = "(shiftright(e.key, 10) & 1023L)", "(e.key & 1023L)"
_OPEN = f"array_position({{c}}, {_START}) > 0 and coalesce(get({{c}}, array_position({{c}}, {_START}) + 1) = {_END}, false)"
_CUT = f"array_remove({{c}}, get({{c}}, array_position({{c}}, {_START})))"

#: Boundaries, as bits, after all merges in one pass over the edges, best first: an edge over two symbols removes the
#: boundary between them. ``late`` tells that a merge opened an edge better than itself, which the pass had left behind.
_PASS = """aggregate(w.merges, named_struct('c', shiftleft(2L, cast(w.n as int)) - 1L, 'late', false), (s, e) ->
  if((s.c & e.ends) = e.ends and bit_count(s.c & e.span) = 3,
    named_struct('c', s.c & ~(e.span ^ e.ends), 'late', s.late or if(e.watched, exists(w.merges, f -> f.key < e.key
      and bit_count(s.c & ~(e.span ^ e.ends) & f.span) = 3 and (s.c & ~(e.span ^ e.ends) & f.ends) = f.ends), false)), s))"""
#: The same with arrays of boundaries, for longer words; every watched merge counts as late.
_LONG_PASS = f"""aggregate(w.merges, named_struct('cuts', sequence(0L, w.n), 'late', false), (s, e) -> if({_OPEN.format(c='s.cuts')},
  named_struct('cuts', {_CUT.format(c='s.cuts')}, 'late', s.late or e.watched), s))"""

#: The same for words with a late edge: each step takes the best open edge of all.
_STEPS = f"""aggregate(sequence(1L, w.n), sequence(0L, w.n), (c, step) -> aggregate(slice(filter(w.merges, e -> {_OPEN.format(c='c')}), 1, 1), c, (d, e) -> {_CUT.format(c='d')}))"""

#: The boundaries of a word: as bits, or as a list for longer words and those with a late edge.
_FOLD = f"""transform(if(w.n <= {BITS}, transform(array({_PASS}), s -> named_struct('bits', s.c, 'late', s.late, 'cuts', cast(null as array<bigint>))),
  transform(array({_LONG_PASS}), s -> named_struct('bits', 0L, 'late', s.late, 'cuts', s.cuts))),
  x -> named_struct('word', w.word, 'bits', if(x.late, 0L, x.bits), 'cuts', if(x.late, {_STEPS}, x.cuts), 'ids', w.ids))[0]"""


def lattices(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(w): the words of a table, of 1 to ``BITS`` characters, in the form that is folded: exploded into substrings, equi-joined to the piece table, grouped by word."""
    order = sorted(((r.score, -r.id) for r in pieces.filter("score is not null").collect()), reverse=True)  # the vocabulary
    ranks = words.sparkSession.createDataFrame([(-i, k) for k, (_, i) in enumerate(order)], "id int, rank long")
    table = pieces.filter("score is not null and length(piece) > 1").join(F.broadcast(ranks), "id").select("piece", "id", "rank")
    longest = table.agg(F.max(F.length("piece"))).first()[0] or 1
    cut = f"flatten(transform(sequence(0, n - 2), s -> transform(sequence(2, least({longest}, n - s)), l -> named_struct('start', s, 'end', s + l, 'piece', substring(word, s + 1, l)))))"
    edges = words.select("word", F.length("word").alias("n")).filter("n > 1").select("word", F.expr(f"inline({cut})")).join(F.broadcast(table), "piece")
    ends = "(shiftleft(1L, start) | shiftleft(1L, end))"
    edge = F.expr(f"named_struct('key', rank * {1 << 40}L + id * {1 << 20}L + start * 1024L + end, 'span', shiftleft(shiftleft(1L, end - start) - 1L, start) | {ends}, 'ends', {ends}, 'watched', true)")
    grouped = edges.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("merges"))  # the edges of one word
    none = "cast(array() as array<struct<key:bigint,span:bigint,ends:bigint,watched:boolean>>)"
    return words.join(grouped, "word", "left").select(F.expr(f"named_struct('word', word, 'n', cast(length(word) as bigint), 'merges', coalesce(merges, {none}), 'ids', cast(null as array<int>))").alias("w"))


#: Rows in whose texts, and the longest text in which, common words are looked for, and how many are taken: they are
#: encoded once and every task starts with them. A word outside them is encoded by the task that meets it, so they
#: change no result.
LOOKED_AT, LOOKED_AT_CHARS, COMMON = 4096, 20_000, 1 << 17


def common_words(docs: DataFrame, pieces: DataFrame, looked_at: int = LOOKED_AT, most: int = COMMON) -> pa.Table:
    """(word, bits, cuts, ids) of the most frequent words of a bounded number of texts, from their lattices as relations."""
    spark = docs.sparkSession
    texts = text_docs(docs).filter(F.length("text") <= LOOKED_AT_CHARS).select("text").take(looked_at)  # reads as many partitions as it needs
    _, distinct, of = block_words(pa.array([r[0] for r in texts], pa.string()))
    counts = {w: n for w, n in zip(distinct, np.bincount(of, minlength=len(distinct)).tolist(), strict=True) if len(w) <= BITS}
    some = sorted(w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = spark.createDataFrame(pa.table({"word": pa.array(some, pa.string())})).repartition(parts, "word")
    return lattices(words, pieces).select(F.expr(_FOLD).alias("f")).select("f.*").toArrow()  # at most `most` short words


def encoded_blocks(docs: DataFrame, pieces: DataFrame, common: list[str], kept: int = KEPT_WORDS) -> DataFrame:
    """(folded, docs, known) of every block: the lattices of its new words folded in the task that reads the block, with no shuffle."""
    first_byte = pieces.filter("piece = '<0x00>'").first()["id"]
    return text_docs(docs).mapInArrow(blocks(pieces, first_byte, common, kept), _BLOCK).selectExpr(f"transform(words, w -> {_FOLD}) AS folded", "docs", "known")


def ids_of(folded: pa.StructArray, table: PieceHash, first_byte: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and where each word's end; the symbols between boundaries are looked up, characters without a piece become bytes."""
    words, bits, cuts, given = (folded.field(name) for name in ("word", "bits", "cuts", "ids"))
    text = words.to_pylist()
    sizes = np.fromiter(map(len, text), np.int64, len(text))
    first = np.concatenate([[0], np.cumsum(sizes)])
    points = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(text)), sizes)
    mask = (bits.to_numpy(zero_copy_only=False)[owner] >> np.minimum(np.arange(len(points)) - first[owner], 62) & 1).astype(bool)
    listed = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
    for i in listed.tolist():
        at = cuts[i].values.to_numpy()[:-1]
        mask[first[i] : first[i + 1]] = False
        mask[first[i] + at] = True
    start = np.flatnonzero(mask)
    size = np.diff(np.append(start, len(points)))
    found = np.full(len(start), -1, np.int64)
    for length, known, spelled, ids, _ in table.by_length:
        own = np.flatnonzero(size == length)
        hashes = np.zeros(len(own), np.uint64)
        for k in range(length):
            hashes = hashes * _STEP + points[start[own] + k].astype(np.uint64) + np.uint64(1)
        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        fits = (known[place] == hashes) & (points[start[own][:, None] + np.arange(length)] == spelled[place]).all(axis=1)
        found[own] = np.where(fits, ids[place], -1)
    extra = np.flatnonzero(found < 0)
    raw = [chr(points[start[i]]).encode() for i in extra.tolist()]  # one character each
    count = np.ones(len(start), np.int64)
    count[extra] = [len(b) for b in raw]
    values = np.repeat(found, count)
    to = np.cumsum(count)
    for i, b in zip(extra.tolist(), raw, strict=True):
        values[to[i] - len(b) : to[i]] = np.frombuffer(b, np.uint8).astype(np.int64) + first_byte
    each = np.bincount(owner[start], weights=count, minlength=len(text)).astype(np.int64) if len(text) else np.zeros(0, np.int64)
    whole = np.flatnonzero(given.is_valid().to_numpy(zero_copy_only=False))
    if len(whole):  # words over LONGEST come with their ids
        parts = np.split(values, np.cumsum(each)[:-1])
        for i in whole.tolist():
            parts[i] = given[i].values.to_numpy()
            each[i] = len(parts[i])
        values = np.concatenate(parts)
    return values.astype(np.int32), np.concatenate([[0], np.cumsum(each)])


def _lists(values: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The lists at some places, one after another; list i is values[ends[i]:ends[i + 1]]."""
    size = ends[at + 1] - ends[at]
    stop = np.cumsum(size)
    return values[np.repeat(ends[at] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]


def assembler(pieces: DataFrame, common: tuple[np.ndarray, np.ndarray]):
    """Function for mapInArrow over folded blocks, in the order of their task: doc_id, words, ids, decoded of each document."""
    rows = [(r.id, r.piece, r.score) for r in pieces.collect()]  # the vocabulary
    first_byte = next(i for i, p, score in rows if score is None and p == "<0x00>")

    def run(batches):
        pool = pa.default_memory_pool()
        table = piece_hash([(p, i, score) for i, p, score in rows if score is not None])
        raw = {i: bytes([int(p[3:5], 16)]) if score is None else p.encode() for i, p, score in rows}
        spelled = [raw.get(i, b"") for i in range(max(raw) + 1)]
        letters, letter_ends = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum([0, *map(len, spelled)])
        for batch in batches:
            for i in range(batch.num_rows):
                folded, docs = batch.column(0)[i].values, batch.column(1)[i].values
                if batch.column(2)[i].as_py() == len(common[1]) - 1:
                    held, ends = common
                fresh, to = ids_of(folded, table, first_byte)
                held, ends = np.concatenate([held, fresh]), np.concatenate([ends, ends[-1] + to[1:]])
                at, n = docs.field(1).flatten().to_numpy(), docs.field(1).value_lengths().to_numpy(zero_copy_only=False)
                words_to = np.cumsum([0, *n])
                ids_to = np.concatenate([[0], np.cumsum(ends[at + 1] - ends[at])])[words_to]
                ids = _lists(held, ends, at)
                bytes_to = np.concatenate([[0], np.cumsum(letter_ends[ids + 1] - letter_ends[ids])])[ids_to]
                data = memoryview(_lists(letters, letter_ends, ids))
                texts = [str(data[a:b], "utf-8")[1:].replace(SPACE, " ") for a, b in zip(bytes_to.tolist(), bytes_to[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [docs.field(0), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(ids_to, pa.int32()), pa.array(ids, pa.int32())), pa.array(texts, pa.string())],
                    ["doc_id", "words", "ids", "decoded"],
                )
                pool.release_unused()

    return run


def encoded(docs: DataFrame, pieces: DataFrame, kind: str = "bpe", kept: int = KEPT_WORDS) -> DataFrame:
    """doc_id, words (number), ids, decoded of every row."""
    if kind == "bpe":
        rows = pieces.collect()  # the vocabulary
        first_byte = next(r.id for r in rows if r.score is None and r.piece == "<0x00>")
        folded = common_words(docs, pieces).to_struct_array().combine_chunks()
        known = ids_of(folded, PieceHash([(r.piece, r.id, r.score) for r in rows if r.score is not None]), first_byte)
        return encoded_blocks(docs, pieces, folded.field("word").to_pylist(), kept).mapInArrow(assembler(pieces, known), "doc_id bigint, words int, ids array<int>, decoded string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.xxhash64("text"))
    places = rows.select("doc_id", "digest", F.posexplode(split_words(F.col("text"))).alias("p", "word"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = places.select("word").distinct().repartition(parts, "word")  # lattices are work, not bytes: no merging of partitions
    table = decode_words(encode_words(distinct, pieces, kind), pieces)
    joined = places.join(table, "word").groupBy("doc_id", "digest").agg(
        F.array_sort(F.array_distinct(F.collect_list(F.struct("p", "ids", "decoded")))).alias("w")
    )
    marked = F.array_join(F.transform("w", lambda x: x["decoded"]), "")
    done = joined.select("doc_id", "digest", F.size("w").alias("words"), F.flatten(F.transform("w", lambda x: x["ids"])).alias("ids"), F.translate(F.substring(marked, 2, 2**31 - 1), SPACE, " ").alias("decoded"))
    return rows.select("doc_id", "digest").join(done, ["doc_id", "digest"], "left").select(
        "doc_id", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"), F.coalesce("decoded", F.lit("")).alias("decoded")
    )


def encoded_digests(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_words, n_tokens, ids_sha256 (of the ids joined by commas), decoded_sha256."""
    pieces = piece_table(docs.sparkSession, path)
    out = encoded(docs, pieces)
    return out.select(
        "doc_id", F.col("words").cast("long").alias("n_words"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
