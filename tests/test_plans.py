"""Reuse over restarts, the commit protocol, and the writer's lease."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.plans.calls import Derived, Forwarded, call, source_with
from tidemark.plans.compose import Composition, Fold, Memo, Slot, Source, Template, code_digest
from tidemark.plans.identity import Unjustified
from tidemark.plans.ledger import Conflict, Ledger, StaleFence
from tidemark.plans.workspace import Workspace, WrongIntent


def facts(spark, rows):
    return spark.createDataFrame(rows, "key string, selected long, sibling long, unread long")


def leaf(_members, facts):
    return _members.join(facts, "key").select("key", "selected", "sibling", (F.col("selected") * 10).alias("score"))


def total(members):
    return members.agg(F.sum("score").alias("total"), F.count("*").alias("n"))


class World:
    def __init__(self, spark, folder, outcome=False):
        self.spark, self.data = spark, [(f"k{i}", i, 0, 0) for i in range(6)]
        self.rows = lambda: facts(spark, self.data)
        self.source = Source("facts", lambda previous: self.rows())
        self.each = Template("leaf", self.source, "key", {"facts": (self.source, "key")}, {"facts": ["selected", "sibling"]}, leaf, gate=lambda m: F.col("unread") >= 0)
        self.fold = Fold("total", self.each, ["score"], total, outcome=outcome)
        self.folder = str(folder)

    def go(self, **options):
        work = Workspace(self.spark, self.folder, "test", self.fold)
        with work.run(**options) as run:
            out = run.resolve(self.fold)
            return out, {k: v for k, v in run.bodies.items() if k != "facts"}


def test_body_counts(spark, tmp_path):
    w = World(spark, tmp_path / "l")
    out, bodies = w.go()
    assert bodies == {"leaf": 6, "total": 1} and out.data.first()["total"] == 150
    assert w.go()[1] == {}, "an unchanged restart runs nothing"
    w.data[1] = ("k1", 1, 0, 9)
    assert w.go()[1] == {}, "an unread field changes nothing"
    w.data[1] = ("k1", 1, 5, 9)
    assert w.go()[1] == {"leaf": 1}, "equal consumed output leaves the fold alone"
    w.data[1] = ("k1", 4, 5, 9)
    out, bodies = w.go()
    assert bodies == {"leaf": 1, "total": 1} and out.data.first()["total"] == 180
    w.data.append(("k9", 2, 0, 0))
    assert w.go()[1] == {"leaf": 1, "total": 1}
    w.data = [(f"k{i}", i, 0, 0) for i in range(6)]
    out, bodies = w.go()
    assert bodies == {} and out.data.first()["total"] == 150, "older evidence makes the older result current"


def test_gate_null_fails_and_blocks_only_the_strict_fold(spark, tmp_path):
    w = World(spark, tmp_path / "a")
    w.data[0] = ("k0", 0, 0, None)
    out, _ = w.go()
    assert out.state == "failed" and out.counts["failed"] == 1
    w = World(spark, tmp_path / "b", outcome=True)
    w.data[0] = ("k0", 0, 0, None)
    out, _ = w.go()
    assert out.state == "published" and out.data.first()["n"] == 6


def test_denied_members_stay_pending(spark, tmp_path):
    w = World(spark, tmp_path / "l")
    few = lambda name, stale: stale.filter("key < 'k3'") if stale is not None else True
    out, bodies = w.go(admit=few)
    assert out.state == "waiting" and bodies == {"leaf": 3} and out.counts["pending"] == 3
    assert w.go()[1] == {"leaf": 3, "total": 1}


def test_check_writes_nothing_and_promotion_shows(spark, tmp_path):
    w = World(spark, tmp_path / "l")
    work = Workspace(spark, w.folder, "test", w.fold)
    assert work.check(w.fold).data is None and work.ledger.commits() == []
    w.go()
    n = len(work.ledger.commits())
    assert work.check(w.fold).state == "reused" and len(work.ledger.commits()) == n
    assert work.preview(w.fold)[0] == "current" and work.preview(w.fold, "other")[0] == "unavailable"
    ids = [r["result_id"] for r in work.ledger.table("results").collect()]
    with work.run() as run:
        with pytest.raises(ValueError):
            run.promote(ids, "main")
        run.promote(ids, "other")
    out, bodies = w.go(environment="other")
    assert bodies == {}


def test_source_policy(spark, tmp_path):
    rows = facts(spark, [("a", 1, 1, 1)])
    calls = []
    s = Source("s", lambda previous: calls.append(previous is None) or (rows if previous is None else None))
    work = Workspace(spark, str(tmp_path / "l"), "t", s)
    for want, basis in (("published", None), ("reused", "check")):
        with work.run() as run:
            out = run.resolve(s)
            assert (out.state, out.reason) == (want, basis)
    final = Source("s", lambda previous: pytest.fail("ran"), finality=lambda previous: True)
    with Workspace(spark, str(tmp_path / "l"), "t", final).run() as run:
        assert run.resolve(final).reason == "finality"
    odd = Source("s", lambda previous: None, finality=lambda previous: "yes")
    with Workspace(spark, str(tmp_path / "l"), "t", odd).run() as run:
        assert run.resolve(odd).state == "failed"


def test_composition_refuses_twice_and_unknown(spark):
    a, b = Source("a", lambda p: None), Source("a", lambda p: None)
    with pytest.raises(ValueError):
        Composition(Memo("m", {"x": a, "y": b}, {"x": [], "y": []}, lambda x, y: x))
    with pytest.raises(LookupError):
        Composition(a).resolve_name("z")


def test_lease_fences_and_commits(spark, tmp_path):
    now = [1000]
    led = Ledger(spark, str(tmp_path / "l"), clock=lambda: now[0])
    a = led.acquire_writer("a", ttl=100)
    assert led.acquire_writer("b") is None
    row = led.rows("journal", [("c", "k", 1, 1, "x")])
    assert led.commit(a, {"journal": row}) == 1
    now[0] = 1100
    b = led.acquire_writer("b", ttl=100)
    assert b.fence == a.fence + 1, "expiry is inclusive"
    with pytest.raises(StaleFence):
        led.commit(a, {"journal": row})
    now[0] = 500
    with pytest.raises(StaleFence):
        led.renew_writer(a)
    with pytest.raises(Conflict):
        led.commit(b, {"journal": row}, expect=9)
    assert led.table("journal").count() == 1 and led.table("journal", version=0).count() == 0
    led.release_writer(b)
    assert led.acquire_writer("c") is not None


def test_staged_rows_without_a_commit_stay_unseen(spark, tmp_path):
    led = Ledger(spark, str(tmp_path / "l"))
    lease = led.acquire_writer("a")
    create = led.files.create
    led.files.create = lambda name, text: (_ for _ in ()).throw(OSError("killed")) if name.startswith("commits/") else create(name, text)
    with pytest.raises(OSError):
        led.commit(lease, {"journal": led.rows("journal", [("c", "k", 1, 1, "x")])})
    led.files.create = create
    assert led.table("journal").count() == 0
    assert led.journal_commit(lease, "c", {"k": (0, "first")}) and not led.journal_commit(lease, "c", {"k": (0, "late"), "j": (0, "x")})
    assert [r["content"] for r in led.table("journal").collect()] == ["first"]


def test_other_layout_is_refused(spark, tmp_path):
    Ledger(spark, str(tmp_path / "l"))
    (tmp_path / "l" / ".layout.json.crc").unlink(missing_ok=True)
    (tmp_path / "l" / "layout.json").write_text("{}")
    with pytest.raises(RuntimeError):
        Ledger(spark, str(tmp_path / "l"))


def test_a_body_that_outlasts_the_lease_publishes(spark, tmp_path):
    source = Source("s", lambda previous: time.sleep(2) or spark.range(3))
    work = Workspace(spark, str(tmp_path / "l"), "t", source)
    with work.run(ttl=600) as run:
        assert run.resolve(source).state == "published"
        assert work.ledger.acquire_writer("other") is None, "the lease is renewed while the run lasts"
    assert work.ledger.writer()["released"] and work.ledger.acquire_writer("other") is not None


def test_an_expired_lease_is_no_error_at_the_end(spark, tmp_path):
    work = Workspace(spark, str(tmp_path / "l"), "t", Source("s", lambda previous: spark.range(3)))
    with work.run(ttl=300) as run:
        run.resolve(work.steps.steps["s"])
        run.keeper.end()
        time.sleep(0.5)
    assert work.ledger.acquire_writer("next") is not None
    with pytest.raises(StaleFence):
        work.ledger.commit(run.keeper.lease, {"facts": []})


def test_a_second_writer_waits(spark, tmp_path):
    folder = str(tmp_path / "l")
    first = Ledger(spark, folder)
    lease = first.acquire_writer("a")
    assert first.try_lease("b")[0] == "held" and Ledger(spark, folder).wait_writer("b", wait=50, poll=20) is None
    threading.Timer(0.4, lambda: first.release_writer(lease)).start()
    got = Ledger(spark, folder).wait_writer("b", wait=20_000, poll=50)
    assert got.fence == lease.fence + 1


def test_a_name_is_taken_once(spark, tmp_path):
    led = Ledger(spark, str(tmp_path / "l"))
    won = []
    threads = [threading.Thread(target=lambda k=k: led.files.create("commits/x.json", str(k)) and won.append(k)) for k in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and led.files.read("commits/x.json") == str(won[0])


def test_checkpoints_give_the_same_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.plans.ledger.CHECKPOINT", 4)
    led = Ledger(spark, str(tmp_path / "l"))
    lease = led.acquire_writer("a")
    for i in range(10):
        led.commit(lease, {"facts": [(f"t{i}", "c", "d")]})
    again = Ledger(spark, str(tmp_path / "l"))
    assert len(again.files.names("checkpoints")) == 2 and again.commits() == led.commits() and again.table("facts").count() == 10 and again.table("facts", version=3).count() == 3


RATE = 2


def helper(x):
    return x * RATE


def other(x):
    return x


def test_evidence_of_what_code_reaches(monkeypatch):
    def make(k):
        return lambda rows: rows.filter(F.col("id") >= k)

    assert code_digest(make(1)) == code_digest(make(1)) != code_digest(make(5))
    body = lambda x: helper(x) + 1
    was = code_digest(body)
    monkeypatch.setitem(globals(), "RATE", 3)
    now = code_digest(body)
    assert now != was, "a global that a called helper reads"
    monkeypatch.setitem(globals(), "other", lambda x: x + 1)
    assert code_digest(body) == now, "a helper that is not called"
    monkeypatch.setitem(globals(), "helper", lambda x: x)
    assert code_digest(body) not in (was, now), "a called helper"
    held = {"rows": object()}
    with pytest.raises(Unjustified):
        code_digest(lambda x: held["rows"])


@pytest.mark.parametrize("kind", ["memo", "template", "fold"])
def test_a_changed_captured_constant_reruns_its_step_alone(spark, tmp_path, kind):
    rows = facts(spark, [(f"k{i}", i, 0, 0) for i in range(10)])
    rows.write.parquet(str(tmp_path / "rows"))

    def go(k):
        least = {n: k if n == kind else 0 for n in ("memo", "template", "fold")}
        source = Source("facts", lambda previous: spark.read.parquet(str(tmp_path / "rows")))
        memo = Memo("memo", {"facts": source}, {"facts": ["key", "selected"]}, (lambda m: lambda facts: facts.filter(F.col("selected") >= m))(least["memo"]))
        each = Template("each", memo, "key", {}, {"_members": ["selected"]}, (lambda m: lambda _members: _members.select("key", (F.col("selected") + m).alias("score")))(least["template"]))
        fold = Fold("fold", each, ["score"], (lambda m: lambda members: members.agg(F.count_if(F.col("score") >= m).alias("n"), F.sum("score").alias("total")))(least["fold"]))
        with Workspace(spark, str(tmp_path / "l"), "t", fold).run() as run:
            return tuple(run.resolve(fold).data.first()), {k: v for k, v in run.bodies.items() if k != "facts"}

    assert go(1)[0] == {"memo": (9, 45), "template": (10, 55), "fold": (9, 45)}[kind]
    want = {"memo": ((5, 35), {"memo": 1, "fold": 1}), "template": ((10, 95), {"each": 10, "fold": 1}), "fold": ((5, 45), {"fold": 1})}[kind]
    assert go(5) == want and go(5)[1] == {}


def test_sources_of_files_are_not_copied(spark, tmp_path):
    data, folder = str(tmp_path / "data"), tmp_path / "l"
    facts(spark, [("a", 1, 1, 1), ("b", 2, 2, 2)]).write.parquet(data)
    read = {"plain": lambda: spark.read.parquet(data), "cut": lambda: spark.read.parquet(data).filter("selected > 0").select("key", (F.col("selected") + 1).alias("selected"))}
    for name, make in read.items():
        source = Source(name, lambda previous, make=make: make())
        work = Workspace(spark, str(folder), "t", source)
        states = []
        for _ in range(2):
            with work.run() as run:
                out = run.resolve(source)
                states.append((out.state, out.data.count()))
        assert states == [("published", 2), ("reused", 2)]
    assert sorted(p.name for p in (folder / "payload").iterdir()) == ["cut"] and len(list((folder / "payload" / "cut").iterdir())) == 1
    keep = Source("plain", lambda previous: None)
    with Workspace(spark, str(folder), "t", keep).run() as run:
        assert run.resolve(keep).data.count() == 2, "the files are read again"
    facts(spark, [("c", 1, 1, 1)]).write.mode("append").parquet(data)
    with Workspace(spark, str(folder), "t", source := Source("plain", lambda previous: spark.read.parquet(data))).run() as run:
        assert run.resolve(source).state == "published"
    udf = F.udf(lambda x: x)
    with Workspace(spark, str(folder), "t", odd := Source("odd", lambda previous: spark.read.parquet(data).withColumn("u", udf("key")))).run() as run:
        run.resolve(odd)
    with Workspace(spark, str(folder), "t", odd).run() as run:
        assert run.resolve(odd).state == "published", "what can't be told apart is taken anew"


def test_an_unchanged_run_reads_no_data(spark, tmp_path):
    w = World(spark, tmp_path / "l")
    data = str(tmp_path / "d")
    w.rows().write.parquet(data)
    w.rows = lambda: spark.read.parquet(data)
    w.go()
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("unchanged", "x")
    out, bodies = w.go()
    assert bodies == {} and out.state == "reused" and len(tracker.getJobIdsForGroup("unchanged")) <= 4, "a job for the schema of each table that is read again, and no other"
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert out.data.first()["total"] == 150


def test_many_changes_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.plans.workspace.MERGE_AFTER", 2)
    w = World(spark, tmp_path / "l")
    for i in range(5):
        w.data[0] = ("k0", 100 + i, 0, 0)
        out, bodies = w.go()
        assert out.data.first()["total"] == 1000 + 10 * i + 150 and bodies["leaf"] == (6 if i == 0 else 1)
    merged = [c for c in Ledger(spark, w.folder).commits() if c["note"].get("kind") == "merge"]
    assert merged and w.go()[1] == {}
    w.data[0] = ("k0", 100, 0, 0)
    assert w.go()[1] == {}, "older evidence is found in the merged table"


def test_a_failing_body_stays_in_its_step(spark, tmp_path):
    source = Source("s", lambda previous: spark.range(3))
    bad = Memo("bad", {"s": source}, {"s": ["id"]}, lambda s: s.select("nothing"))
    above = Memo("above", {"bad": bad}, {"bad": ["id"]}, lambda bad: bad)
    good = Memo("good", {"s": source}, {"s": ["id"]}, lambda s: s.filter("id > 0"))
    events = []
    work = Workspace(spark, str(tmp_path / "l"), "t", above, good)
    with work.run(observe=lambda e: events.append(e) or (_ for _ in ()).throw(RuntimeError("deaf"))) as run:
        out = run.resolve(above)
        assert out.state == "failed" and "nothing" in out.reason and run.resolve(good).data.count() == 2
        assert run.ordinary("count", lambda: 5) == 5 and run.diagnostics and run.diagnostics[0].startswith("observer")
    assert {e["kind"] for e in events} >= {"published", "abandoned", "failed", "ordinary-begin", "ordinary-end"}
    reasons = {(r["subject"], r["reason"]) for r in work.ledger.records("misses")}
    assert ("above", "child-refused") in reasons and work.preview(good)[0] == "current"
    assert {r["kind"] for r in work.ledger.records("events")} >= {"abandoned", "ordinary-end"}


def test_requests_by_key(spark, tmp_path):
    source = Source("s", lambda previous: spark.range(3))
    memo = Memo("m", {"s": source}, {"s": ["id"]}, lambda s: s.filter("id > 0"))
    work = Workspace(spark, str(tmp_path / "l"), "t", memo)
    with work.run() as run:
        assert run.recover(memo, "ask") == "absent"
        run.resolve(memo, "ask")
        assert run.recover(memo, "ask") == "recovered" and run.recovered(memo, "ask").count() == 2
    other = Memo("m", {"s": source}, {"s": ["id"]}, lambda s: s.filter("id > 1"))
    with Workspace(spark, str(tmp_path / "l"), "t", other).run() as run, pytest.raises(WrongIntent):
        run.resolve(other, "ask")
    stale = Workspace(spark, str(tmp_path / "l"), "t", other)
    assert stale.check(other).misses[0][1] == "changed"


def test_slots_calls_and_witnesses(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 3), (2, "a", 13), (3, "b", 3)], "id long, kind string, n long")
    source, slot = Source("rows", lambda previous: rows), Slot("scorer")
    use = Memo("use", {"scored": slot}, {"scored": ["id", "score"]}, lambda scored: scored)
    one = Memo("plain", {"rows": source}, {"rows": ["id", "n"]}, lambda rows: rows.select("id", F.col("n").alias("score")))
    two = Memo("double", {"rows": source}, {"rows": ["id", "n"]}, lambda rows: rows.select("id", (F.col("n") * 2).alias("score")))
    folder = str(tmp_path / "l")
    for bound, total in ((one, 19), (two, 38), (one, 19)):
        work = Workspace(spark, folder, "t", use, bind={"scorer": bound})
        with work.run() as run:
            assert run.resolve(use).data.agg(F.sum("score")).first()[0] == total
    assert work.steps.reconnect(work.steps.witness("use", "scorer")) == (use, one)
    for bind, state in (({}, "missing"), ({"scorer": (one, two)}, "ambiguous")):
        work = Workspace(spark, folder, "t", use, bind=bind)
        with work.run() as run:
            assert run.resolve(use).reason == f"{state}-binding: scorer"
    assert {r["reason"] for r in work.ledger.records("misses")} >= {"missing-binding", "ambiguous-binding"}

    ran = spark.sparkContext.accumulator(0)

    def body(_members):
        return _members.select("key", F.concat_ws(":", "kind", F.col("rest").cast("string")).alias("said"))

    step = call("say", source, ["id"], {"kind": Forwarded("kind"), "rest": Derived("n % 10", ("n",))}, body, ["said"])
    for want in ({"say": 2}, {}):
        work = Workspace(spark, folder, "calls", step)
        with work.run() as run:
            assert sorted(map(tuple, run.resolve(step).data.select("id", "said").collect())) == [(1, "a:3"), (2, "a:3"), (3, "b:3")]
            assert {k: v for k, v in run.bodies.items() if k == "say"} == want
    with pytest.raises(Unjustified):
        call("bad", source, ["id"], {"f": lambda x: x}, body, ["said"])
    assert ran.value == 0
    made = [source_with("range", lambda previous, n: spark.range(n), {"n": n}) for n in (3, 3, 4)]
    assert made[0].name == made[1].name != made[2].name


def test_check_members(spark, tmp_path):
    w = World(spark, tmp_path / "l")
    w.go()
    w.data[2] = ("k2", 77, 0, 0)
    w.data[3] = ("k3", 3, 0, None)
    states = Workspace(spark, w.folder, "test", w.fold).check_members(w.each)
    assert states.count() == 6, "a check reads the source that is retained"
    assert {r.state for r in states.collect()} == {"reusable"}


def test_untracked_columns_are_no_evidence(spark, tmp_path):
    data = [(1, "a")]
    source = Source("s", lambda previous: spark.createDataFrame(data, "id long, note string"))
    memo = Memo("m", {"s": source}, {"s": ["id"]}, lambda s: s, untracked={"s": ("note",)})
    for note, want in (("a", {"m": 1}), ("b", {})):
        data[0] = (1, note)
        work = Workspace(spark, str(tmp_path / "l"), "t", memo)
        with work.run() as run:
            assert run.resolve(memo).data.first().note == "a" and {k: v for k, v in run.bodies.items() if k == "m"} == want
    assert [r["detail"] for r in work.ledger.records("events") if r["kind"] == "untracked"] == ["s: note"] * 2


def test_a_failing_policy_is_a_failed_source(spark, tmp_path):
    good = Source("s", lambda previous: spark.range(2))
    with Workspace(spark, str(tmp_path / "l"), "t", good).run() as run:
        run.resolve(good)
    for bad in (Source("s", lambda previous: 1 / 0), Source("s", lambda previous: None, finality=lambda previous: 1 / 0)):
        with Workspace(spark, str(tmp_path / "l"), "t", bad).run() as run:
            assert run.resolve(bad).state == "failed" and "ZeroDivisionError" in run.resolve(bad).reason
    assert Workspace(spark, str(tmp_path / "l"), "t", good).ledger.table("results").count() == 1
