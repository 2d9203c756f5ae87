"""Small cases of functions, sources, folds and streaming."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark import functions as V
from tidemark.operators import evidence, keyed, ledger_views, rates
from tidemark.plans.ledger import Ledger
from tidemark.sources.readers import Malformed, PagedSource, RowStore, bisect_days, read_roster, select_people
from tidemark.streaming.operations import Operations, PermitPool, RateLimited, StopController
from tidemark.streaming.traversal import Observation, Traversal, live_counts


def test_number_tokens_stay_apart(spark):
    rows = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert rows.select(V.row_token(rows, ["x"]).alias("t")).distinct().count() == 5


def test_safe_integers_overflow(spark):
    with pytest.raises(Exception, match="overflows"):
        spark.range(1).select(V.safe_add(F.lit(V.SAFE), F.lit(1))).collect()


def test_keys_order_by_utf16(spark):
    rows = spark.createDataFrame([("\U0001f600",), ("￿",)], "k string")
    assert [r.k for r in rows.orderBy(V.canonical_order(F.col("k"))).collect()] == ["\U0001f600", "￿"]


def test_keying_failures(spark):
    with pytest.raises(keyed.KeyingError, match="missing-key"):
        keyed.keyed(spark.createDataFrame([("a",), (None,), ("a",)], "k string"), F.col("k"))
    with pytest.raises(keyed.KeyingError, match="duplicate-key"):
        keyed.keyed(spark.createDataFrame([("a",), ("a",)], "k string"), F.col("k"))
    assert keyed.keyed(spark.createDataFrame([], "k string"), F.col("k")).count() == 0


@pytest.mark.parametrize(
    ("statuses", "discovery", "strict", "outcome"),
    [([], "complete", "ready", "ready"), (["succeeded", "skipped"], "complete", "ready", "ready"), (["failed"], "complete", "failed", "ready"), (["pending"], "complete", "waiting", "waiting"), (["succeeded"], "open", "waiting", "waiting"), (["failed", "pending"], "open", "failed", "waiting"), ([], "rejected", "failed", "failed"), ([], "denied", "waiting", "waiting"), (["cancelled"], "complete", "failed", "ready")],
)
def test_readiness(spark, statuses, discovery, strict, outcome):
    m = spark.createDataFrame([(str(i), s) for i, s in enumerate(statuses)], "key string, status string")
    assert keyed.readiness(m, discovery).state == strict and keyed.readiness(m, discovery, outcome=True).state == outcome


def test_key_evidence_ignores_row_order_and_sees_copies(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2)], "k string, v long")
    b = spark.createDataFrame([("k", 2), ("k", 1)], "k string, v long")
    c = spark.createDataFrame([("k", 1), ("k", 2), ("k", 2)], "k string, v long")
    one = [evidence.key_evidence(x, "k", ["v"]).first()["evidence"] for x in (a, b, c)]
    assert one[0] == one[1] != one[2]


def test_next_admission_needs_room(spark):
    d = spark.createDataFrame([("g", 0, 3), ("g", 5, 3)], "gate string, at long, cost long")
    assert rates.next_admission(d, "gate", "at", "cost", 10, 6, 2, 7).first()["admit_at"] == 10
    assert rates.next_admission(d, "gate", "at", "cost", 10, 8, 2, 7).first()["admit_at"] == 7
    assert rates.next_admission(d, "gate", "at", "cost", 10, 1, 2, 7).first()["admit_at"] is None


def test_read_gate(spark):
    spark.range(3).createOrReplaceTempView("seen")
    assert ledger_views.read_query(spark, "WITH x AS (SELECT id FROM seen) SELECT count(*) AS n FROM x", {"seen"}).first()["n"] == 3
    spark.range(3).createOrReplaceTempView("secret")
    fine = ["SELECT s.id FROM seen s JOIN seen r USING (id) WHERE s.id IN (SELECT max(id) FROM seen) ORDER BY 1 LIMIT 2", "SELECT sum(id) OVER (ORDER BY id) AS n FROM seen", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT max(n) AS n FROM r"]
    for good in fine:
        assert ledger_views.read_query(spark, good, {"seen"}).count() >= 1
    bads = ["DROP VIEW seen", "SELECT * FROM other", "CREATE TABLE t AS SELECT 1", "select * from secret where '' <> ', secret as ('", "select reflect('java.lang.System','getProperty','user.home')"]
    bads += ["select java_method('java.lang.System','getProperty','user.home') from seen", "select * from parquet.`/tmp/x`", "with a as (select * from secret) select * from a", "with secret as (select * from secret) select * from secret"]
    bads += ["select id from seen where id = (select max(id) from secret)", "select input_file_name() from seen", "select * from range(3)", "select current_user()", "select id from seen union select id from secret", "select * from read_files('/tmp')", "select explode(array(reflect('a', 'b'))) from seen", "from seen |> where id > 0", "select spark_catalog.default.f(id) from seen"]
    for bad in bads:
        with pytest.raises(PermissionError):
            ledger_views.read_query(spark, bad, {"seen"})


def test_roster(spark, tmp_path):
    f = tmp_path / "r.csv"
    f.write_text('employee_id,github_login,name,active\n1,a,"A, B",true\n2,b,B,false\n')
    r = read_roster(spark, str(f))
    assert select_people(r, ["1"]).first()["name"] == "A, B"
    for wrong in (["1", "1"], ["2"], ["9"]):
        with pytest.raises(Malformed):
            select_people(r, wrong)
    f.write_text("id,x\n1,2\n")
    with pytest.raises(Malformed):
        read_roster(spark, str(f))


def test_bisected_days_and_pages(spark):
    days = bisect_days(date(2024, 1, 1), date(2024, 1, 9), lambda a, b: (b - a).days * 3, 6)
    assert days[0][0] == date(2024, 1, 1) and days[-1][1] == date(2024, 1, 9) and all((b - a).days <= 2 for a, b in days)
    with pytest.raises(Malformed):
        bisect_days(date(2024, 1, 1), date(2024, 1, 2), lambda a, b: 9, 6)
    spark.dataSource.register(PagedSource)
    assert spark.read.format("tidemark_pages").option("pages", 3).option("size", 4).load().count() == 12


def test_day_ranges_as_a_table_function(spark):
    from tidemark.sources import functions

    functions.register(spark)
    rows = spark.sql("SELECT * FROM day_ranges(DATE '2024-01-01', DATE '2024-01-10', 4)").collect()
    assert [(r.first.day, r.last.day) for r in rows] == [(1, 5), (5, 9), (9, 10)]
    assert spark.sql("SELECT * FROM day_ranges(DATE '2024-01-10', DATE '2024-01-10', 4)").count() == 0


def test_places_count_over_all_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"))
    got = keyed.places(rows, F.col("v")).collect()
    assert sorted(r.place for r in got) == list(range(1, 5001))
    assert [r.v for r in sorted(got, key=lambda r: r.place)] == sorted(r.v for r in got)
    assert keyed.places(rows.limit(0), F.col("v")).count() == 0
    m = spark.createDataFrame([(k, s) for k, s in zip("dacbe", ["succeeded"] * 3 + ["failed"] * 2)], "key string, status string")  # noqa: B905
    assert sorted((r.status, r.place, r.key) for r in keyed.status_keys(m).collect()) == [("failed", 1, "b"), ("failed", 2, "e"), ("succeeded", 1, "a"), ("succeeded", 2, "c"), ("succeeded", 3, "d")]


@pytest.mark.parametrize("conf", [{"spark.sql.adaptive.enabled": "false"}, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}])
def test_places_when_ranges_are_drawn_from_samples(spark, conf):
    old = {k: spark.conf.get(k) for k in conf}
    rows = spark.range(0, 40000, 1, 8).select((F.col("id") * 7919 % 40009).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("other"))
    members = rows.select(F.col("v").cast("string").alias("key"), F.when(F.col("v") % 3 == 0, "failed").otherwise("succeeded").alias("status"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted((r.place, r.v) for r in keyed.places(rows, F.col("v")).collect())
        keys = sorted((r.status, r.place, r.key) for r in keyed.status_keys(members).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = sorted(i * 7919 % 40009 for i in range(40000))
    assert got == list(enumerate(want, 1))
    of = {s: sorted(str(v) for v in want if (v % 3 == 0) == (s == "failed")) for s in ("failed", "succeeded")}
    assert keys == [(s, i, k) for s in ("failed", "succeeded") for i, k in enumerate(of[s], 1)]


def test_errors_stay_with_their_member(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 0)], "key string, v long")
    got = {r.key: r for r in keyed.per_member(rows, lambda key, x: {"inverse": float(1 // x.v.min())}, "inverse double").collect()}
    assert got["a"].status == "succeeded" and got["a"].inverse == 1.0 and got["b"].status in ("failed", "succeeded")


def test_row_store():
    s = RowStore()
    s.put_subject("a", lease_until=5)
    assert s.cas_subject("a", 1, lease_until=9) and not s.cas_subject("a", 1, lease_until=1)
    assert s.expired_claims(10, 3) == ["a"] and s.expired_claims(9, 3) == []
    s.put_fields("a", {"x": 1, "y": 2})
    assert s.get_fields("a", ["x", "z"]) == {"x": 1} and set(s.get_fingerprints("a", ["x", "y"])) == {"x", "y"}


def test_traversal_merges_and_refuses(spark, tmp_path):
    t = Traversal(spark, str(tmp_path / "t"), "id", ["url"])
    t.take(spark.createDataFrame([(1, "a"), (2, "b")], "id long, url string"), 0)
    t.take(spark.createDataFrame([(2, "b"), (3, "c")], "id long, url string"), 1)
    assert t.members()[0] == "open" and t.members()[1].count() == 3
    with pytest.raises(ValueError):
        t.take(spark.createDataFrame([(3, "z")], "id long, url string"), 2)
    assert len(list((tmp_path / "t" / "pages").iterdir())) == 2, "a page that disagrees leaves nothing"
    t = Traversal(spark, str(tmp_path / "t"), "id", ["url"])
    t.take(spark.createDataFrame([(9, "z")], "id long, url string"), 1)
    assert t.members()[1].count() == 3, "a batch taken before is not taken again after a restart"
    t.finish()
    assert t.members()[0] == "complete" and Traversal(spark, str(tmp_path / "t"), "id", ["url"]).status == "complete" and t.revision == 3


def test_traversal_goes_on_from_its_cursor_and_gates_a_composition(spark, tmp_path):
    from tidemark.plans.compose import Memo
    from tidemark.plans.workspace import Workspace

    loaded = []

    def load(cursor):
        n = int(cursor or 0)
        loaded.append(n)
        return spark.createDataFrame([(n, f"u{n}"), (n + 1, f"u{n + 1}")], "id long, url string"), str(n + 1) if n < 3 else None

    make = lambda most=None: Traversal(spark, str(tmp_path / "t"), "id", ["url"]).source("found", load, most)
    for most, want in ((2, "failed"), (None, "published"), (None, "reused")):
        source = make(most)
        step = Memo("names", {"found": source}, {"found": ["url"]}, lambda found: found.select("url"))
        with Workspace(spark, str(tmp_path / "l"), "t", step).run() as run:
            out = run.resolve(step)
            assert out.state == want
    assert loaded == [0, 1, 2, 3] and out.data.count() == 5


def test_streamed_pages_and_counts(spark, tmp_path):
    spark.range(20).selectExpr("id", "concat('u', id) as url").write.json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long, url string").json(str(tmp_path / "in"))
    t = Traversal(spark, str(tmp_path / "t"), "id", ["url"])
    t.follow(stream(), str(tmp_path / "c"))
    assert t.members()[0] == "complete" and t.members()[1].count() == 20
    live_counts(stream().selectExpr("id % 2 as kind"), "kind", "live", most=7).awaitTermination()
    assert {r.n for r in spark.table("live").collect()} == {7}


def test_operations_retry_and_settle(spark, tmp_path):
    now = [0]
    led = Ledger(spark, str(tmp_path / "l"), clock=lambda: now[0])
    ops = Operations(led, led.acquire_writer("a", ttl=10**9), clock=lambda: now[0])
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 2:
            raise RuntimeError("busy")
        return "done"

    assert ops.run("x", flaky).status == "waiting"
    assert ops.run("x", flaky).status == "waiting" and len(tries) == 1
    now[0] = 5000
    assert ops.run("x", flaky).value == "done" and ops.run("x", flaky).status == "succeeded" and len(tries) == 2

    def killed():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        ops.run("y", killed)
    assert ops.run("y", lambda: pytest.fail("sent twice")).status == "unsettled"
    assert [o.key for o in ops.inspect("unsettled")] == ["y"] and len(ops.inspect()) == 2
    assert ops.settle("y", "known").value == "known"
    slept, tried = [], []

    def later():
        tried.append(1)
        if len(tried) < 3:
            raise RateLimited("later")
        return "sent"

    def sleep(s):
        slept.append(s)
        now[0] += int(s * 1000)

    assert ops.passes({"z": later}, sleep=None) == now[0] + 2000 and ops.state(ops.get("z")) == "rate-limited"
    assert ops.passes({"z": later}, sleep=sleep) is None and ops.get("z").value == "sent" and sum(slept) == 6
    stop = StopController(lambda: now[0])
    stop.stop("soft")
    assert ops.send("w", lambda: pytest.fail("sent after the stop"), PermitPool(1), stop).status == "new" and not ops.sleep_until(now[0] + 5, sleep, stop)
    pool = PermitPool(1)
    assert ops.send("w", lambda: "w1", pool).value == "w1" and pool.free == 1
    seen = Observation(led.files)
    seen.write(phase="running")
    seen.write(phase="done")
    assert Observation(led.files).read() == {"revision": 2, "phase": "done"}


def test_permits_and_stop():
    p = PermitPool(1)
    assert p.acquire("a") and not p.acquire("b") and not p.acquire("c", priority=1)
    assert p.release() == "c" and p.cancel("b") and p.release() is None and p.acquire("d")
    now = [0]
    s = StopController(lambda: now[0])
    s.stop("soft", grace=5)
    assert s.now() == "soft"
    now[0] = 5
    assert s.now() == "hard"
    s.stop("soft")
    assert s.now() == "hard"


def test_payload_tree_selects_and_verifies(spark):
    from tidemark.operators import tree

    df = spark.createDataFrame([(1, ("a", [1, None]), None), (2, None, [("x",)])], "id long, r struct<k:string,v:array<long>>, s array<struct<q:string>>")
    index = tree.shred(df, "id")
    got = {(r["key"], r["address"]): (r["kind"], r["scalar"]) for r in index.collect()}
    assert got[1, '["r","v",1]'] == ("scalar", None) and got[1, '["r","v",0]'] == ("scalar", "1") and got[2, '["s",0,"q"]'] == ("scalar", "x") and got[2, '["r"]'] == ("scalar", None)
    assert tree.verified(df, "id", index) and not tree.verified(df, "id", index.filter("key = 1"))


def test_gates_pass_together():
    from tidemark.streaming.gates import RateSurface

    s = RateSurface()
    s.register("a", 3, 10)
    s.register("b", 5, 10)
    r, _ = s.admit({"a": 2, "b": 2}, 0)
    s.commit(r, 0)
    r, again = s.admit({"a": 2, "b": 2}, 4)
    assert r is None and again == 10
    assert s.admit({"a": 4}, 4) == (None, None)
    r, _ = s.admit({"b": 3}, 4)
    s.rollback(r)
    s.observe_cooldown("b", 30)
    assert s.admit({"b": 1}, 11) == (None, 30)
    r, _ = s.admit({"a": 3}, 10)
    assert r is not None
    with pytest.raises(ValueError):
        s.register("a", 9, 10)


def test_cells_keep_values_and_failures():
    from tidemark.plans.local import Cells

    c = Cells()
    x, runs = c.cell(1), []

    def body():
        runs.append(1)
        if x.get() == 3:
            raise ValueError("three")
        return x.get() // 2

    half = c.derived(body)
    double = c.derived(lambda: runs.append(2) or half.get() * 2)
    assert double.get() == 0 and double.get() == 0 and runs == [2, 1]
    x.set(0)
    assert double.get() == 0 and runs == [2, 1, 1], "an equal derived value leaves its readers alone"
    x.set(3)
    for _ in range(2):
        with pytest.raises(ValueError):
            half.get()
    assert runs.count(1) == 3


def test_cli_verbs(spark, tmp_path, capsys):
    import json

    from tidemark import cli

    ledger = str(tmp_path / "l")
    assert cli.main(["observe", ledger]) == 1
    assert cli.main(["start", ledger, "/root/testdata/sf0.001"]) == 0
    assert cli.main(["observe", ledger]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["phase"] == "published"
    rid = Ledger(spark, ledger).table("results").filter("subject = 'report'").first()["result_id"]
    assert cli.main(["read-result", ledger, rid]) == 0 and cli.main(["read-result", ledger, "none"]) == 1


def test_subtrees_end_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2, "edge"), (2, 3, "edge"), (3, 1, "edge"), (2, 4, "prototype"), (1, 4, "edge")], "parent long, child long, kind string")
    got = ledger_views.subtree(edges, 1)
    assert sorted(map(tuple, got.collect())) == [(1, 0), (2, 1), (3, 2), (4, 1)]
    assert sorted(map(tuple, ledger_views.subtree(edges, 2, ("prototype",)).collect())) == [(2, 0), (4, 1)]
    protos = spark.createDataFrame([(1, 2), (2, 1)], "node long, prototype long")
    keys = spark.createDataFrame([(1, "a"), (2, "b")], "node long, key string")
    assert ledger_views.has_key(protos, keys, 1, "b") == (False, True) and ledger_views.has_key(protos, keys, 1, "z") == (False, False)


def test_records_and_values_are_canonical(spark):
    rows = spark.createDataFrame([('{"b": 1, "a": "x"}',), ("[1, 2",), (None,)], "t string")
    assert [r[0] for r in rows.select(V.encode_value(F.col("t"))).collect()] == ['{"a":"x","b":1}', None, None]
    assert [r[0] for r in rows.select(V.decode_value(F.col("t")).isNull()).collect()] == [True, True, True]
    with pytest.raises(Exception, match="given twice"):
        spark.sql("select array(named_struct('key', 'a', 'value', 1), named_struct('key', 'a', 'value', 2)) as e").select(V.record_from_entries(F.col("e"))).collect()


def test_details_and_discussions(spark, tmp_path):
    from tidemark.sources.readers import discussion_items, read_details

    (tmp_path / "p.json").write_text('{"id": "1", "title": "t", "merged": true}\n')
    (tmp_path / "d.json").write_text('{"id": "1", "reviews": [{"id": 5, "author": "a", "at": 1}], "comments": [], "inlineComments": [{"id": 6, "author": "b", "at": 2}]}\n')
    _, d = read_details(spark, str(tmp_path / "p.json"), str(tmp_path / "d.json"))
    assert sorted(map(tuple, discussion_items(d).collect())) == [("1", "inlineComments", 6, "b", 2), ("1", "reviews", 5, "a", 1)]
    (tmp_path / "d.json").write_text('{"id": "2"}\n')
    with pytest.raises(Malformed):
        read_details(spark, str(tmp_path / "p.json"), str(tmp_path / "d.json"))


def test_addresses_of_any_length_and_entry_data(spark):
    from tidemark.operators import tree

    name = "k" * (1 << 20)
    index = spark.createDataFrame([(1, f'["{name}x"]', "scalar"), (1, "[]", "record")], "key long, address string, kind string")
    assert tree.keys_below(index, "[]").first().names == [f'"{name}x"']
    rows = keyed.entries(spark.createDataFrame([("a", "succeeded", 1), ("b", "failed", None)], "key string, status string, v long"), ["v"])
    with pytest.raises(Exception, match="b is failed"):
        rows.select(keyed.entry_data(rows, "v")).collect()


def test_dispatch_keeps_order_and_errors():
    from tidemark.streaming.operations import dispatch

    started = []
    work = {k: (lambda k=k: started.append(k) or (1 / 0 if k == "b" else k.upper())) for k in "cab"}
    got = dispatch(work, window=1)
    assert started == ["a", "b", "c"] and got["a"] == ("succeeded", "A") and got["b"][0] == "failed"
    stop = StopController()
    stop.stop("soft")
    assert {v[0] for v in dispatch(work, stop=stop).values()} == {"not-started"} and len(started) == 3
