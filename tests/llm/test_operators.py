"""The training-data operators against brute force, round trips and awkward rows."""

import hashlib
import html as entities
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, html, jaccard, language, licences, neighbours, packing, pieces_lattice, queries, secrets, telephony, toxicity

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, label string, score double, rank int, node long, run long"


def odd_docs(spark, rows):
    """Documents with extra columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, "en", s, 0, "x", 1.0, 2, 3, 4) for i, t, s in rows], ODD)


EDGE = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "same text here " * 9, "a"), (4, "same text here " * 9, "a"), (5, "same text here " * 9, "b"), (6, "long " + "word " * 30000, "a"), (7, "é" * 5000, "a")]
OPERATORS = {
    "jaccard": lambda s, d: jaccard.jaccard_components(d),
    "licences": lambda s, d: licences.licences(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, s.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")),
    "language": lambda s, d: language.languages(d),
    "packing": lambda s, d: packing.packed(d),
    "secrets": lambda s, d: secrets.secrets(d),
    "telephony": lambda s, d: telephony.media_columns(d),
    "pieces": lambda s, d: pieces_lattice.encoded_digests(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edge_rows_and_empty_tables(spark, name):
    rows = EDGE
    got = OPERATORS[name](spark, odd_docs(spark, rows)).collect()
    ids = sorted(r["doc_id"] for r in got)
    if name == "packing":
        assert set(ids) == {i for i, _, _ in rows} and len([r for r in got if r["doc_id"] == 4]) == 2
    else:
        assert ids == sorted(i for i, _, _ in rows)
    assert OPERATORS[name](spark, odd_docs(spark, [])).count() == 0


# -- op1 --------------------------------------------------------------------------------------
def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[500:530] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, []), (1100, [float("inf")] * 16)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard=300).toPandas()
    assert set(got.query_id) == set(range(0, 900, 20))
    exact = x.astype(np.float64)
    hit = 0
    for q, g in got.groupby("query_id"):
        s = exact @ exact[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -np.round(s, 9)))[:20]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g.score, s[g.vec_id])
        hit += len(set(want) & set(g.vec_id))
    assert hit / (45 * 20) >= 0.97
    few = neighbours.nearest(spark.createDataFrame(rows[:3] + rows[900:], "vec_id long, embedding array<float>"))
    assert few.count() == 2
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# -- op2 --------------------------------------------------------------------------------------
def test_pages_give_their_articles(spark):
    for r in queries.QUERIES["op2_html"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?p>|</?h1>", inner))
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


PAGE = """<body><header><a href=/>Site</a></header><nav><a href=/a>One</a><a href=/b>Two</a></nav>
<div class="main-content"><h1>A &lt;title&gt; &amp; more</h1><p>The first paragraph is  a real sentence,
with enough words to be read.<p>And the second one follows it&#8212;right here, just as long.</div>
<aside>Related: <a href=/c>Another story</a></aside><div id="comments"><p>I liked this one very much, thank you for it.</p></div>
<form><label>Mail</label><input></form><script>var x = "<p>no</p>";</script><footer>&copy; 2020 Someone</footer>"""


def test_boilerplate_goes_and_broken_markup_is_read():
    assert html.extract(PAGE) == "A <title> & more\n\nThe first paragraph is a real sentence, with enough words to be read.\n\nAnd the second one follows it—right here, just as long."
    rng = random.Random(1)
    for _ in range(200):
        cut = "".join(PAGE[i : i + 9] for i in rng.sample(range(0, len(PAGE), 9), 40))
        assert isinstance(html.extract(cut), str)
    assert html.extract(None) == html.extract("") == html.extract("<nav>x</nav>") == ""


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(1, 8)
        cost = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        value = lambda side: sum(max(c, 0) if not s else max(-c, 0) for c, s in zip(cost, side)) + sum(w for a, b, w in edges if side[a] != side[b])  # noqa: B023, B905, E731
        best = min(value([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(value(html.min_cut(cost, edges)) - best) < 1e-6


# -- op3 --------------------------------------------------------------------------------------
def brute_components(rows):
    def words(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t.translate({i: i + 32 for i in range(65, 91)})) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, words(t or "")) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def test_jaccard_same_as_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(900)]
    base = [rng.choice(vocab) for _ in range(110)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocab) if rng.random() < p else w for w in base)) for i in range(130) for p in [rng.choice([0.005, 0.01, 0.02, 0.04])]]
    rows += [(i, " ".join(passage[: rng.randint(20, 60)] + rng.choices(vocab, k=rng.randint(0, 60)))) for i in range(200, 270)]
    rows += [(i, rows[3][1].upper()) for i in range(300, 330)]
    rows += [(i, " ".join(rng.choices(vocab[:6], k=rng.randint(0, 14)))) for i in range(400, 600)]
    rows += [(700, None), (701, ""), (702, "\n\t")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a = rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64)
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(1, 200)).astype(np.uint64)]))
        a = np.unique(a)
        x, y = (jaccard.bit_sketches(s, np.array([0, len(s)]))[0] for s in (a, b))
        assert jaccard.hamming(x, y) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df().sort_values("doc_id").astype(object)
    got = queries.QUERIES[name](spark, SF).toPandas().sort_values("doc_id").astype(object)
    assert got[sorted(got)].fillna("").values.tolist() == want[sorted(want)].fillna("").values.tolist()


# -- op4 --------------------------------------------------------------------------------------
def test_licence_variants(spark):
    mit = licences.KNOWN[0][1]
    variants = [mit, mit.upper(), "Copyright (c) 2020 A. Person\n" + mit.replace("sublicense", "sub-licence").replace(",", " ,"), mit + " but changed", "text\nreleased  under the MIT licence!\nmore", None, "© 2020"]
    got = licences.licences(spark.createDataFrame(list(enumerate(variants)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text_licence"] for r in got] == ["MIT", "MIT", "MIT", None, None, None, None]
    assert got[4]["line_licences"] == "MIT" and got[4]["n_lines"] == 1 and got[6]["text_digest"] is None


# -- op5 --------------------------------------------------------------------------------------
def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held.toxic).mean() > 0.93 and got.score.between(0, 1).all()
    crc = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id}
    assert all(crc[i] == h for i, h in zip(got.doc_id, got.held_out, strict=True))


def test_identity_terms_lose_their_weight(spark):
    rng = random.Random(4)
    words = [f"plain{i}" for i in range(40)]
    rows = [(i, " ".join([*rng.choices(words, k=9), "vilesttt" if i % 2 else "kindest", "muslim" if i % 2 and i % 10 != 1 else "christian"]), i % 2) for i in range(600)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "plain1 muslim plain2"), (2, "plain1 christian plain2"), (3, "plain1 vilesttt plain2")], "doc_id long, text string")
    gap = {}
    for fair in (0.0, 30.0):
        s = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(probe, toxicity.train(docs, labels, fair=fair)).collect()}
        gap[fair] = abs(s[1] - s[2])
        assert s[3] > 0.5
    assert gap[30.0] < 0.3 * gap[0.0]
    assert toxicity.Swapper()("Black cats") == "white cats" and toxicity.Swapper()("blackboard") is None


# -- op6 --------------------------------------------------------------------------------------
def test_pieces_equal_the_library_and_decode(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces_lattice.MODEL)
    texts = ["Hello  world, it's   fine", " lead and tail ", "line\nbreak\n\n x", "Éèaux ça ſ 門含 😀", "aaaaaaaaaa", "a", " ", ""]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 12").collect()]
    got = pieces_lattice.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pieces_lattice.piece_table(spark)).collect()
    for r in got:
        assert r["ids"] == model.encode(texts[r["doc_id"]]) and r["decoded"] == texts[r["doc_id"]]


def test_viterbi_finds_the_best_path(spark):
    rng = random.Random(8)
    table = {c: -rng.uniform(4, 6) for c in "abc"} | {"".join(rng.choices("abc", k=rng.randint(2, 4))): -rng.uniform(3, 9) for _ in range(20)}
    ids = {p: i + 256 for i, p in enumerate(table)}
    pieces = spark.createDataFrame([(f"<0x{b:02X}>", b, None) for b in range(256)] + [(p, ids[p], s) for p, s in table.items()], "piece string, id int, score double")
    words = ["".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(60)]
    low = min(table.values()) - 10

    def best(w):
        at = [0.0]
        for e in range(1, len(w) + 1):
            at.append(max(at[s] + table.get(w[s:e], low if e - s == 1 else -1e9) for s in range(max(0, e - 4), e)))
        return at[-1]

    back = {i: p for p, i in ids.items()}
    for r in pieces_lattice.encode_words(spark.createDataFrame([(w,) for w in set(words)], "word string"), pieces, "unigram").collect():
        assert "".join(back.get(i, chr(i)) for i in r["ids"]) == r["word"]
        assert abs(sum(table[back[i]] if i in back else low for i in r["ids"]) - best(r["word"])) < 1e-9


# -- op7 --------------------------------------------------------------------------------------
def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()
    none = language.languages(docs.withColumn("text", F.lit("12 %")))
    assert {r[0] for r in none.select("lang_pred").distinct().collect()} == {"und"}


# -- op8 --------------------------------------------------------------------------------------
def test_best_fit_is_tightest_compatible():
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randint(1, 60)
        sizes = sorted((rng.randint(1, 20) for _ in range(n)), reverse=True)
        sources, clusters = [rng.choice("aab") for _ in range(n)], [rng.randint(0, 20) for _ in range(n)]
        bins: list[list[int]] = []
        for i, (b, o) in enumerate(packing.best_fit(sizes, sources, clusters, 20)):
            rest = lambda k: 20 - sum(sizes[j] for j in bins[k])  # noqa: B023, E731
            fits = [k for k in range(len(bins)) if rest(k) >= sizes[i] and all(clusters[j] != clusters[i] for j in bins[k]) and sum(sources[j] == sources[i] for j in bins[k]) < 2]
            assert (b == len(bins)) if not fits else (b in fits and rest(b) == min(map(rest, fits)))
            if b == len(bins):
                bins.append([])
            assert o == 20 - rest(b)
            bins[b].append(i)


# -- op9 --------------------------------------------------------------------------------------
BASE = [
    re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"),
]


def test_spans_equal_regular_expressions():
    rng = random.Random(3)
    bits = ["password", "Token", "secret", "apikey", "API_KEY", "passwd", "=", ":", " ", '"', "'", "abc", "abcdef12", "é", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "\n", "x", ".", "==", "gho_", "Zq" * 20]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        want = sorted((m.start(), k, m.end()) for k, e in enumerate(BASE) for m in e.finditer(t) if (len(m[2]) >= 6 if k == 0 else m.end() - m.start() >= (20, 24)[k - 1]))
        assert [s for s in secrets.spans(t) if s[1] < 3] == want
    t = "x token=abcdefg1 gho_" + "Zq" * 20
    assert [s[1] for s in secrets.spans(t)] == [0, 3] and secrets.redact(t) == "x [SECRET] [SECRET]" and secrets.redact(None) is None


# -- op10 -------------------------------------------------------------------------------------
def slow_ima(block):
    now, at = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [now]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[at])
            d = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            now = max(-32768, min(32767, now - d if code & 8 else now + d))
            at = max(0, min(88, at + int(telephony.CHANGES[code])))
            out.append(now)
    return out


def test_media_round_trip_and_decoders(spark):
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (7, 192)).astype(np.uint8)
    assert telephony.decode_ima(blocks).tolist() == [slow_ima(b.tobytes()) for b in blocks]
    mu, a = telephony.mu_law_table(), telephony.a_law_table()
    assert mu[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0] and a[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256
    for r in queries.QUERIES["op10_telephony"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        data = r["text"].encode()
        pay = data + b" " * (-len(data) % 192 or (192 if not data else 0))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        media = telephony.write_wav(pay)
        assert r["media_sha256"] == hashlib.sha256(media).hexdigest() and telephony.read_wav(media) == (7, 8000, pay)
        pcm = telephony.write_wav(telephony.resample_double(mu[np.frombuffer(pay, np.uint8)], np.array([0, len(pay)])).astype("<i2").tobytes(), telephony.PCM, 16000, 16)
        assert (r["pcm_bytes"], r["pcm_sha256"]) == (len(pcm), hashlib.sha256(pcm).hexdigest())
    assert telephony.media_features([telephony.payload_of("a"), telephony.payload_of("b" * 500)])[0][1] == telephony.media_features([telephony.payload_of("b" * 500)])[0][0]
    with pytest.raises(ValueError):
        telephony.read_wav(telephony.write_wav(b"x" * 192)[:-1])
    tag, rate, pcm = telephony.read_wav(bytes(telephony.resampled_pcm(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()["pcm"]))
    assert (tag, rate) == (telephony.PCM, 16000) and np.frombuffer(pcm, "<i2").tolist() == [int(mu[32])] * 384
    row = telephony.stored_media(spark.createDataFrame([(1, "é")], "doc_id long, text string")).first()
    assert bytes(row.payload) == "é".encode() + b" " * 190 and telephony.read_wav(bytes(row.media))[2] == bytes(row.payload)


# -- pipeline ---------------------------------------------------------------------------------
def test_pipeline_keeps_and_drops(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = corpus_pipeline.toxic_out(spark, docs, SF)
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet").filter(toxicity.fold_mod("doc_id", 5) != 0))
    keep = {r["doc_id"] for r in toxicity.toxicity_scores(docs, model).filter("score < 0.5").collect()}
    assert {r["doc_id"] for r in toxic.collect()} == keep and toxic.schema == docs.schema
    told = corpus_pipeline.language_known(spark, docs, SF)
    assert told.columns == docs.columns and told.count() == docs.count()
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"] for r in corpus_pipeline.one_of_near_copies(spark, docs, SF).collect()}
    assert got == {i for i, (_, c) in want.items() if i == c}
    clean = corpus_pipeline.secrets_redacted(spark, docs, SF)
    assert clean.columns == docs.columns and not any(secrets.spans(r["text"]) for r in clean.collect())
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.collect()} <= keep & got and out.count() > 0


def test_pieces_of_long_words_and_letter_soup_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces_lattice.MODEL)
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abeinorstth"), n)) for n in (61, 62, 63, 64, 200, 500)] + ["a" * 300, "the" * 80, " " * 90, "é" * 70 + "ß語"]
    texts += ["".join(rng.choice(list("etaoin ths"), 400)) for _ in range(20)]
    got = pieces_lattice.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pieces_lattice.piece_table(spark)).collect()
    for r in got:
        assert r.ids == model.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id]
    assert len(got) == len(texts)


def test_pieces_of_words_of_any_length_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces_lattice.MODEL)
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("abeinorstth"), n)) for n in (511, 512, 513, 600, 700, 1023, 1024, 1100, 20000)]
    texts += ["a" * 600, "the" * 200, "".join(rng.choice(list("0123456789abcdef"), 700)), "門é😀ab" * 400, "before " + "the" * 5000 + " after\n" + "x" * 3000 + "\n" + " " * 800, "th" * 10000]
    texts += ["".join(rng.choice(list("etaoinhs"), 700)) for _ in range(20)]
    got = pieces_lattice.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pieces_lattice.piece_table(spark)).collect()
    for r in got:
        assert r.ids == model.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id]
    assert len(got) == len(texts)
    words = spark.createDataFrame([(t,) for t in texts[9:14]], "text string").select("text", pieces_lattice.split_words(F.col("text")).alias("words")).collect()
    assert all(r.words == pieces_lattice.words_of(r.text) for r in words)


def test_pipeline_run_equals_brute_force_with_null_and_repeated_rows(spark, tmp_path):
    import corpus_pipeline

    base = spark.read.parquet(f"{SF}/documents.parquet")
    some = base.orderBy("doc_id").limit(90).collect()
    alone = "a quiet {} sentence of plain words about rivers, bridges and long walks in the {} hills of the north"
    extra = [some[3], some[3], some[40]]  # repeated rows
    extra += [r.asDict() | {"doc_id": None} for r in (some[7], some[50])]  # null ids, copies of rows with an id
    extra += [some[0].asDict() | {"doc_id": None, "text": alone.format(w, w) + " and its own " + " ".join(f"{w}{k}" for k in range(30))} for w in ("green", "brown", "brown")]
    extra += [some[0].asDict() | {"doc_id": i, "text": "the same id carries another text here " + " ".join(f"{i}word{k}" for k in range(40))} for i in (some[9].doc_id, some[9].doc_id + 10**6)]
    extra += [some[0].asDict() | {"source": None, "lang": None, "n_chars": None, "doc_id": 10**7}]
    docs = spark.createDataFrame([tuple(r) for r in some] + [tuple(r[c] for c in base.columns) for r in extra], base.schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = corpus_pipeline.Scratch(spark, "clean").table(corpus_pipeline.toxic_out(spark, docs, str(tmp_path)), "clean")
    told = corpus_pipeline.language_known(spark, clean, str(tmp_path)).collect()
    assert sum(r.doc_id is None for r in told) >= 3
    told.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0))
    groups = brute_components([(i, r.text) for i, r in enumerate(told)])
    want = []
    for i, r in enumerate(told):
        if groups[i][1] == i:
            left = len(re.findall(r"[^ \t\n\x0b\f\r]+", secrets.redact(r.text)))
            room = packing.ROOM
            want += [(repr(r.doc_id), k, min(room, left - k * room)) for k in range(max(1, -(-left // room)))]
    got = [(repr(r.doc_id), r.piece, r.n_words) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_full_licence_texts(spark):
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"]
    folder = licences.resources.files("tidemark.llm").joinpath("licence_texts")
    texts = [(n, folder.joinpath(f"{n}.txt").read_text()) for n in names]
    assert all(len(t) > 1000 for _, t in texts)
    rows = [(n, f) for n, t in texts for f in (t, t.upper(), t.replace("\n", "\r\n"), "Copyright (c) 2020 A. Person\n\n" + t)]
    rows += [(n, t.split("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS\n") for n, t in texts if "END OF TERMS" in t]
    rows += [(n, t.replace("* Redistributions of", "1. Redistributions of").replace("* Redistributions in", "2. Redistributions in").replace("* Neither", "3. Neither").split("\n", 1)[1]) for n, t in texts if n.startswith("BSD")]
    rows += [(None, t + " but changed") for _, t in texts]
    got = licences.licences(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text_licence"] for r in got] == [n for n, _ in rows]


def test_long_texts_of_distinct_words_pair_in_one_partition():
    words = [f"w{i}" for i in range(300_000)]
    texts = pa.array([" ".join(words), " ".join([*words[:-20], "another", "end"])])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), texts], names=["doc_id", "text"])
    packed = list(jaccard._packed_words(5, 75, 1)(iter([batch])))
    counts = [np.frombuffer(r.as_py(), np.int64, 2) for b in packed for r in b.column(1)]
    assert max(e / m for m, e in counts) > 65535
    pairs = [(k, a, b) for o in jaccard._bucket_pairs(iter(packed)) for k, a, b in zip(*(c.to_pylist() for c in o.columns), strict=True)]
    h, off = jaccard.shingle_sets(texts)
    assert pairs == [(0, *sorted(jaccard._set_keys(h, off)[0].tolist()))]


def test_pieces_of_many_blocks_when_kept_words_are_forgotten(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces_lattice.MODEL)
    rng = random.Random(12)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choices(words[i * 60 : i * 60 + 160], k=160_000)) for i in range(4)] + ["", "the end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for kept in (100, 1 << 19):
        got = pieces_lattice.encoded(docs, pieces_lattice.piece_table(spark), kept=kept).collect()
        assert len(got) == len(texts)
        for r in got:
            assert r.ids == model.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id] and r.words == len(pieces_lattice.words_of(texts[r.doc_id]))


def test_licence_lines_of_any_length_and_of_repeated_ids(spark):
    mit = licences.KNOWN[0][1].split("\n\n", 1)[1].replace("\n\n", " ")
    rows = [(1, "Released under the MIT License." + " " * 6000 + "\nother"), (2, "dedicated\nThis work is dedicated  to the public  domain -- under CC0 1.0."), (3, "a\n" + "-" * 9000 + " " + mit + " " + "*" * 9000)]
    rows += [(4, "Released under the MIT licence"), (4, "Licensed under CC BY 4.0\n\nLicensed under CC BY 4.0\nReleased under the MIT License"), (4, "Released under the MIT licence"), (None, "Released under the MIT licence\nx"), (None, "x")]
    got = licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.line_licences, r.n_lines) for r in got) == sorted([(1, "MIT", 1), (2, "CC0-1.0", 1), (3, "", 0), (4, "MIT", 1), (4, "CC-BY-4.0,MIT", 3), (4, "MIT", 1), (0, "MIT", 1), (0, "", 0)])
    own = (("BSD-3-Clause", "SPDX: BSD-3-Clause"), ("two", "cc by"))
    assert licences.anchors(spark, own) is None and licences.anchors(spark, own[:1]) == "clause"
    got = licences.licences(spark.createDataFrame([(1, "spdx -- bsd 3 CLAUSE\nCreative Commons Attribution")], "doc_id long, text string"), own).first()
    assert (got.line_licences, got.n_lines) == ("BSD-3-Clause,two", 2)
    many = own + tuple((f"L{i}", f"known text number {i}") for i in range(licences.FEW))
    assert licences.licences(spark.createDataFrame([(1, "Known text, number 77!")], "doc_id long, text string"), many).first().text_licence == "L77"


ARTICLE = "<article><h1>News of the day</h1><p>This is a sentence of the article with enough words to be read as text.</p></article>"
SENTENCE = "This is a sentence of the article with enough words to be read as text."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title><meta charset=utf-8>{ARTICLE}", f"<head><title>x</title><link rel=a>{ARTICLE}", f"<body><svg><path>{ARTICLE}",
        f"<body><div><select><option>a</div>{ARTICLE}<select><option>b</select>", f"<title>never closed{ARTICLE}", f"<body><video><noscript>{ARTICLE}",
        f"<body><div><canvas><div>gone</div></div>{ARTICLE}<canvas></canvas>", f"<head><noscript><p>no</p></noscript></head><body>{ARTICLE}</body>",
    ],
)
def test_no_open_element_silences_the_article(page):
    assert html.extract(page) == f"News of the day\n\n{SENTENCE}"


def test_deep_and_long_pages_take_linear_room():
    deep = "<div>" * 50_000 + ARTICLE + "</x>" * 50_000 + "<svg>" * 1000 + f"<p>{SENTENCE}</p>" * 2000
    got = html.extract("<body>" + deep)
    assert got.startswith("News of the day") and got.count(SENTENCE) == 2001
    assert html.extract("<script>" + ARTICLE) == ""


def test_html_edge_rows(spark):
    rows = [(1, "u", ARTICLE, "x", 1), (1, "u", ARTICLE, "x", 1), (2, None, None, None, None), (None, "v", "", "x", 3), (3, "w", ARTICLE + f"<p>{SENTENCE}</p>" * 30_000, "t", 4)]
    schema = "page_id long, url string, html string, text string, n_chars long"
    got = html.main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text[:4], r.n_chars == len(r.text)) for r in got) == [(0, "v", "", True), (1, "u", "News", True), (1, "u", "News", True), (2, "", "", True), (3, "w", "News", True)]
    assert html.main_text(spark.createDataFrame([], schema)).count() == 0


def test_label_is_the_cheapest_of_all_labellings(spark):
    """op2's query against every labelling of the same blocks, costs and ties."""
    page = "<body><nav><a href=/a>One</a></nav><div><p>A first sentence of some length, with words.</p><ul><li><a href=/b>Link</a></li></ul><p>Another one follows here, as long as it.</p></div><footer>(c) 2020</footer>"
    found = html.blocks(page)
    html.classify(found)
    ties = html.ties(found)
    value = lambda side: sum(max(b.cost, 0) if not s else max(-b.cost, 0) for b, s in zip(found, side, strict=True)) + sum(w for a, b, w in ties if side[a] != side[b])
    best = min(([bool(m >> i & 1) for i in range(len(found))] for m in range(1 << len(found))), key=lambda s: (round(value(s), 9), s))
    got = html.main_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first().text
    assert got == "\n\n".join(b.text for b, s in zip(found, best, strict=True) if s) and got.startswith("A first")


def test_words_of_a_block_are_the_words_of_its_texts():
    rng = random.Random(2)
    texts = [None, "", " ", "  a", "a\n\n b ", "\n", "▁▁ a▁b"] + ["".join(rng.choice("ab  \n▁é") for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    for some in (texts, [*texts, "a\0b c"]):
        ends, words, of = pieces_lattice.block_words(pa.array(some, pa.string()))
        assert [[words[k] for k in of[a:b]] for a, b in zip(ends, ends[1:])] == [pieces_lattice.words_of(t) for t in some]  # noqa: B905


def test_neighbours_of_large_and_double_vectors(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 8))
    x[17], x[40, 3], x[60] = x[17] * 1e20, 1e150, x[60] * 1e-200
    x[100:105] += 1e-12 * rng.normal(size=(5, 8))
    rows = [(i, v.tolist(), 1, 2.0, "x") for i, v in enumerate(x)] + [(20, x[20].tolist(), 1, 2.0, "x"), (None, x[0].tolist(), 1, 2.0, "x"), (2000, [1.0, 2.0], 1, 2.0, "x"), (2001, [3.0, 2.0], 1, 2.0, "x")]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep long, score double, shard string")).toPandas()
    assert got[got.query_id == 2000].vec_id.tolist() == [2001]
    got = got[got.query_id != 2000]
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(300), -s))[:20]
        g = g.sort_values("rank")
        assert len(set(g.vec_id)) == 20 == len(g) and np.allclose(g.score, s[g.vec_id], rtol=1e-12)
        hit += len(set(want) & set(g.vec_id))
    assert got.query_id.nunique() == 15 and hit / (15 * 20) >= 0.97


def test_jaccard_rows_with_null_and_repeated_ids(spark):
    rng = random.Random(9)
    text = lambda w, n=40: " ".join(f"{w}{rng.randint(0, 9)}{k}" for k in range(n))
    a, b, c, d = text("a"), text("b"), text("c"), text("d")
    rows = [(9, a), (4, a + " end"), (4, b), (7, b), (4, b), (None, c), (3, c), (None, d), (None, d), (5, None), (5, ""), (None, None), (8, text("e"))]
    got = jaccard.jaccard_components(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, row long, group long, node long")).collect()
    want = [(9, 4), (4, 4), (4, 4), (7, 4), (4, 4), (None, 3), (3, 3), (None, None), (None, None), (5, 5), (5, 5), (None, None), (8, 8)]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=key) == sorted(want, key=key)


def test_long_words_made_to_hash_alike_differ(spark):
    tail = " some other words that follow it here"
    thue = ["".join("ab"[bin(i).count("1") & 1] for i in range(2048)), "".join("ba"[bin(i).count("1") & 1] for i in range(2048))]
    rows = [(i, t + tail) for i, t in enumerate(thue)] + [(i + 5, t) for i, t in enumerate(thue)]
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0: 0, 1: 0, 5: 5, 6: 6} | ({1: 1} if brute_components(rows)[1][1] == 1 else {})


def test_learners_take_one_row_of_an_id(spark):
    rows = [(i % 40, f"{'alpha beta' if i % 2 else 'gamma delta'} {i % 40}", "xx" if i % 2 else "yy") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    solve, language.solve = language.solve, lambda bits, labels: seen.append(len(labels)) or solve(bits, labels)
    fit, toxicity.fit = toxicity.fit, lambda x, y, change, **o: seen.append(len(y)) or fit(x, y, change, **o)
    try:
        language.train(docs)
        toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    finally:
        language.solve, toxicity.fit = solve, fit
    assert 30 <= seen[0] <= 40 and seen[1] == 40
    many = spark.createDataFrame([(i, f"word{i} text", f"l{i % 9}") for i in range(900)], "doc_id long, text string, lang string")
    assert language.train(many, languages=4)["langs"] == ["l0", "l1", "l2", "l3"]


def test_spans_of_other_secrets_and_of_texts_beyond_ascii():
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "MIIabc+/12" * 6 + "=\n"
    text = "é" * 9 + pem + "門 " + "é token=abcdef1 " * 3000
    got = [(secrets.RULES[r][0], text[s:e]) for s, r, e in secrets.spans(text)]
    assert got == [("key", pem)] + [("assign", "token=abcdef1")] * 3000
    assert secrets.redact(text) == "é" * 9 + "[SECRET]門 " + "é [SECRET] " * 3000


def test_pipeline_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = base.withColumns({"kept_id": F.lit(1), "row0": F.lit(2), "kept_row": F.lit(3), "component_id": F.lit(4), "score": F.lit(5.0), "size": F.lit(6), "shard": F.lit(7)})
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        (labels if name == "odd" else labels.limit(0)).write.parquet(f"{folder}/labels.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, now, folder).columns == docs.columns
        out = corpus_pipeline.run(spark, folder)
        assert (out.count() == 0) == (name == "empty")


def test_packed_query_holds_every_word_once_and_keeps_its_rules(spark):
    """op8's query: pieces cover each document's words, bins hold their room, sources and clusters, and each shard is best fit."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op8_packing"](spark, SF).toPandas()
    words = {r.doc_id: (len(re.findall(r"[^ \t\n\x0b\f\r]+", r.text or "")), r.source, " ".join((r.text or "").lower().split())) for r in docs.collect()}
    assert got.groupby("doc_id").n_words.sum().to_dict() == {i: n for i, (n, _, _) in words.items()}
    full = got[got.bin_id.notna()].sort_values(["bin_id", "bin_start"])
    for _, b in full.groupby("bin_id"):
        assert b.bin_start.tolist() == [0, *np.cumsum(b.n_words)[:-1]] and b.n_words.sum() <= packing.ROOM
        assert b.doc_id.map(lambda i: words[i][1] or "").value_counts().max() <= packing.PER_SOURCE and b.doc_id.map(lambda i: words[i][2]).is_unique
    order = full.assign(c=full.doc_id.map(lambda i: words[i][2])).sort_values(["n_words", "doc_id", "piece"], ascending=[False, True, True])
    bins = [b & 0xFFFFFFFF for b in order.bin_id.astype("int64")]
    want = packing.best_fit(order.n_words.tolist(), order.doc_id.map(lambda i: words[i][1]).tolist(), order.c.tolist(), packing.ROOM)
    assert full.bin_id.astype("int64").floordiv(1 << 32).nunique() == 1 and sorted(zip(bins, order.bin_start, strict=True)) == sorted(want)


def test_jaccard_shuffles_only_texts_that_a_pair_names(spark):
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    texts = [" ".join(hashlib.sha256(f"{d}-{i}".encode()).hexdigest() for i in range(300)) for d in range(300)]
    rows = [*enumerate(texts), (300, texts[0] + " end"), (301, texts[7] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = shuffled()
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == {**{d: d for d in range(300)}, 300: 0, 301: 7}
    assert shuffled() - before < sum(len(t) for t in texts) / 2


def test_pipeline_stages_hold_small_batches_and_shrink_the_heap(spark, tmp_path):
    """A task's input isn't one Arrow batch, and each stage begins with a full collection of the executors' garbage."""
    import corpus_pipeline

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    keys = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    had = {k: spark.conf.get(k) for k in keys}
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    base = spark.read.parquet(f"{SF}/documents.parquet").schema
    row = F.struct(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 2000).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(22000).cast("long").alias("n_chars"))
    spark.range(0, 300, 1, 1).select(row.alias("r")).select(*(F.col(f"r.{f.name}").cast(f.dataType).alias(f.name) for f in base)).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    try:
        for name, stage in corpus_pipeline.STAGES:
            for k, v in zip(keys, ("64m", "4096"), strict=True):
                spark.conf.set(k, v)
            before = collections()
            stage(spark, docs, str(tmp_path))
            assert collections() - before >= (2 if name in ("toxicity", "language") else 1)  # once more when a model has been learned
            seen = docs.mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(r.n for r in seen) == 300 and max(r.bytes for r in seen) < common.BATCH_BYTES + 100_000
            assert int(spark.conf.get(keys[1])) == common.COLUMN_ROWS
        for k, v in zip(keys, ("100k", "7"), strict=True):
            spark.conf.set(k, v)
        common.small_batches(spark)
        assert [spark.conf.get(k) for k in keys] == ["100k", "7"]  # a session's own smaller limits stay
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)


def test_ended_bodies_give_memory_back():
    code = """
import re, sys
import numpy as np
from tidemark.llm import common
kept = []
def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
def body(batches):
    some = [np.ones(10_000) for _ in range(2000)]
    kept.append(np.ones(10_000))  # above all others, so that the heap can't just end sooner
    yield from batches
before = held()
list(body([])); plain = held() - before
list(common.freed(body)([])); print(plain, held() - before)
"""
    plain, freed = map(int, subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True).stdout.split())
    assert plain > 100 > 30 > freed
