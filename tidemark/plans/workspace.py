"""Runs over a ledger: resolve, check, recover, folds, promotion, usage.

Fan-out is one plan, not a task for each member: current evidence of all keys is compared
with retained evidence by one join; only stale keys reach the body. Evidence covers consumed
columns and code, never ids of child results, so that a recomputed child with equal consumed
output leaves its parents alone (early cutoff), and evidence seen before makes the older
result current again.

Results never change, so a digest of some columns of one is taken once and kept as a fact; a
source whose plan and files are as before gives the result that it gave before. A run over
unchanged inputs therefore reads rows of the ledger and no data.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import row_token
from ..operators import evidence, keyed
from . import snapshot
from .compose import Composition, Fold, Memo, Slot, Source, Step, Template, code_digest
from .identity import Unjustified
from .ledger import Conflict, Keeper, Ledger, StaleFence
from .usage import Usage

#: Errors of the run itself; all others stay in the step, or in its members.
RUN_LEVEL = (StaleFence, Conflict, LookupError, Unjustified)
#: Publications of one template that are read together before they are merged into one.
MERGE_AFTER = 16


class WrongIntent(RuntimeError):
    """A request key that was used for something else."""


@dataclass
class Outcome:
    """What a request came to: its rows, whether they were reused, and how many bodies ran."""

    step: str
    data: DataFrame | None
    state: str  # published, reused, recovered, pending, waiting, failed
    bodies: int = 0
    counts: dict = field(default_factory=dict)
    reason: str | None = None
    token: str | None = None
    misses: list = field(default_factory=list)


def table_digest(df: DataFrame, columns: list[str]) -> str:
    """Order-independent digest of the consumed columns of a whole table."""
    one = df.select(F.lit("all").alias("_k"), *sorted(columns))
    row = evidence.key_evidence(one, "_k", sorted(columns)).first()
    return row["evidence"] if row else "empty"


def digest_of(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


class Run:
    def __init__(self, ledger: Ledger, steps: Composition, analysis: str, environment: str, admit: Callable[[str, DataFrame | None], DataFrame | bool] | None = None, write: bool = True, ttl: int = 30_000, wait: int = 0, observe: Callable[[dict], None] | None = None):
        self.ledger, self.steps, self.analysis, self.environment = ledger, steps, analysis, environment
        self.admit, self.write, self.ttl, self.observe = admit, write, ttl, observe
        self.lease = ledger.wait_writer(f"run-{uuid.uuid4().hex[:8]}", ttl, wait) if write else None
        if write and self.lease is None:
            raise RuntimeError("another writer holds the ledger")
        self.keeper = Keeper(ledger, self.lease, ttl) if write else None
        self.done: dict[str, Outcome] = {}
        self.bodies: dict[str, int] = {}
        self.notes: dict[str, list[tuple]] = {}
        self.diagnostics: list[str] = []

    # -- writing --------------------------------------------------------------------------
    def _note(self, table: str, *row) -> None:
        if self.write:
            self.notes.setdefault(table, []).append(row)

    def _commit(self, tables: dict, note: dict, expect: int | None = None) -> int:
        """Notes not yet committed go with the next commit, or at the end."""
        notes, self.notes = self.notes, {}
        both = {k: [*notes.get(k, []), *tables.get(k, [])] for k in {*notes, *tables}}
        try:
            return self.ledger.commit(self.lease, both, note, expect)
        except Exception:
            self.notes = notes
            raise

    def event(self, kind: str, name: str, detail: str = "") -> None:
        """A run event: kept in the ledger, and told to the observer, whose failure is only a diagnostic."""
        self._note("events", self.analysis, self.environment, kind, name, detail, self.ledger.clock())
        if self.observe:
            try:
                self.observe({"kind": kind, "name": name, "detail": detail})
            except Exception as e:
                self.diagnostics.append(f"observer: {e}")

    def close(self) -> None:
        if self.lease:
            try:
                if self.notes:
                    self._commit({}, {"kind": "notes"})
            except StaleFence:
                self.diagnostics.append("the lease was lost before the last notes were written")
            finally:
                self.keeper.end()
                self.ledger.release_writer(self.lease)
                self.lease = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    # -- retained results -----------------------------------------------------------------
    def _mine(self, table: str, **want) -> list[dict]:
        return [r for r in self.ledger.records(table) if r["analysis"] == self.analysis and all(r[k] == v for k, v in want.items())]

    def candidates(self, step: Step) -> list[dict]:
        """Results visible here of this version, newest first: published here or promoted to here."""
        shared = {p["result_id"] for p in self._mine("promotions", environment=self.environment)}
        seen = [r for r in self._mine("results", subject=step.name, version=step.version) if r["environment"] == self.environment or r["result_id"] in shared]
        return sorted(seen, key=lambda r: -r["publication"])  # one row for each retained run of one step

    def read(self, path: str) -> DataFrame | None:
        """The rows of a result: its payload, or the files it stands for if they are as they were."""
        if path.startswith("{"):
            return snapshot.read_again(self.ledger.spark, json.loads(path))
        return self.ledger.spark.read.parquet(f"{self.ledger.root}/{path}")

    def _claim(self, step: Step, fact: str, key: str | None) -> tuple[str, str]:
        """The attempt's row, written before the work: (attempt id, key). The same key with another intent is refused."""
        number = len(self.ledger.commits()) + 1
        key = key or f"{step.name}#{number}"
        intent = digest_of(type(step).__name__, step.name, step.version, self.environment, fact)
        had = self.attempts(step, key)
        if had and had[-1]["intent"] != intent:
            raise WrongIntent(f"{key} was asked for with another intent")
        rid = uuid.uuid4().hex
        self._commit({"attempts": [(rid, self.analysis, self.environment, step.name, key, step.version, intent, "claimed", None, self.lease.fence)]}, {"step": step.name, "kind": "claim"})
        return rid, key

    def attempts(self, step: Step, key: str) -> list[dict]:
        return self._mine("attempts", subject=step.name, attempt_key=key, environment=self.environment)

    def _publish(self, step: Step, rid: str, key: str, data: DataFrame, fact: str, bodies: int, parts: dict, inputs: list[str], note: dict | None = None, path: str | None = None) -> DataFrame:
        number = len(self.ledger.commits()) + 1
        if path is None:
            path = f"payload/{step.name}/{number:010d}-{rid[:8]}"
            data.write.mode("errorifexists").parquet(f"{self.ledger.root}/{path}")
        intent = self.attempts(step, key)[-1]["intent"]
        row = (rid, self.analysis, self.environment, step.name, step.version, number, fact, json.dumps(parts, sort_keys=True), path, bodies)
        attempt = (rid, self.analysis, self.environment, step.name, key, step.version, intent, "completed", None, self.lease.fence)
        deps = [(rid, i, d) for i, d in enumerate(inputs)]
        self._commit({"results": [row], "attempts": [attempt], "dependencies": deps}, {"step": step.name, **(note or {})}, expect=number)
        self.event("published", step.name, rid)
        return self.read(path)

    def _abandon(self, step: Step, rid: str, key: str, error: Exception) -> None:
        intent = self.attempts(step, key)[-1]["intent"]
        said = f"{type(error).__name__}: {error}"[:1000]
        self._commit({"attempts": [(rid, self.analysis, self.environment, step.name, key, step.version, intent, "abandoned", said, self.lease.fence)]}, {"step": step.name, "kind": "abandoned"})
        self.event("abandoned", step.name, said)

    def _accept(self, step: Step, result_id: str, basis: str = "validated") -> None:
        self._note("acceptances", uuid.uuid4().hex, self.analysis, self.environment, step.name, result_id, basis, self.lease.fence if self.lease else None)

    def _ran(self, step: Step, n: int) -> None:
        self.bodies[step.name] = self.bodies.get(step.name, 0) + n

    def _missed(self, step: Step, had: list[dict], parts: dict, n: int = 1) -> list[tuple[str, str]]:
        """Why no candidate was reused, newest first; each is told apart by the first of its parts that differs."""
        found = []
        for r in had:
            was = json.loads(r["parts"] or "{}")
            gone = [k for k in was if k not in parts]
            new = [k for k in parts if k not in was]
            differs = [k for k in parts if k in was and parts[k] != was[k]]
            if gone or new:
                reason = "correspondence"
            elif any(k.startswith("columns:") for k in differs):
                reason = "incompatible"
            elif "code" in differs:
                reason = "changed"
            elif "membership" in differs:
                reason = "changed-membership"
            elif "members" in differs:
                reason = "changed-member-output"
            elif any(k.startswith("child:") for k in differs):
                reason = "changed-child-output"
            elif differs:
                reason = "changed"
            else:
                reason = "unavailable"
            found.append((r["result_id"], reason))
        for rid, reason in found or [(None, "cold")]:
            self._note("misses", self.analysis, self.environment, step.name, rid, reason, n)
        return found or [(None, "cold")]

    def digest(self, token: str, name: str, make: Callable[[], str]) -> str:
        """A digest over a result that never changes; it is computed once and kept as a fact."""
        for r in [*(dict(zip(("token", "columns", "digest"), r, strict=True)) for r in self.notes.get("facts", ())), *self.ledger.records("facts")]:
            if (r["token"], r["columns"]) == (token, name):
                return r["digest"]
        got = make()
        self._note("facts", token, name, got)
        return got

    def columns_digest(self, got: Outcome, columns: list[str]) -> str:
        if got.token is None:
            return table_digest(got.data, columns)
        return self.digest(got.token, ",".join(sorted(columns)), lambda: table_digest(got.data, columns))

    # -- requests -------------------------------------------------------------------------
    def resolve(self, step: Step, request_key: str | None = None) -> Outcome:
        """Each step is resolved once a run. With a request key the attempt is found again by ``recover``."""
        step = self.steps.bound(step)
        if step.name not in self.done:
            self.steps.resolve_name(step.name)
            kind = {Source: self._source, Memo: self._memo, Template: self._template, Fold: self._fold}[type(step)]
            self.done[step.name] = kind(step, request_key)
        return self.done[step.name]

    def _guarded(self, step: Step, work: Callable[[], object]):
        """(value, None), or (None, a failed outcome): an error of the step's own code is not the run's."""
        try:
            return work(), None
        except RUN_LEVEL:
            raise
        except Exception as e:
            self.event("failed", step.name, f"{type(e).__name__}: {e}"[:1000])
            return None, Outcome(step.name, None, "failed", reason=f"{type(e).__name__}: {e}"[:1000])

    def _admitted(self, step: Step) -> bool:
        return self.write and not (self.admit and self.admit(step.name, None) is False)

    def _source(self, step: Source, key: str | None) -> Outcome:
        had = self.candidates(step)
        previous = self.read(had[0]["path"]) if had else None
        token = had[0]["result_id"] if previous is not None else None
        if previous is not None and step.finality is not None:
            final, bad = self._guarded(step, lambda: step.finality(previous))
            if bad or not isinstance(final, bool):
                return bad or Outcome(step.name, None, "failed", reason="policy: finality must be a boolean")
            if final:
                self._accept(step, token, "finality")
                return Outcome(step.name, previous, "reused", reason="finality", token=token)
        if not self.write:
            return Outcome(step.name, previous, "reused" if previous is not None else "pending", reason="uncertain", token=token)
        if not self._admitted(step):
            return Outcome(step.name, None, "pending")
        got, bad = self._guarded(step, lambda: step.run(previous))
        if bad:
            return bad
        if got is None:
            if previous is None:
                return Outcome(step.name, None, "failed", reason="nothing to retain")
            self._accept(step, token, "check")
            return Outcome(step.name, previous, "reused", reason="check", token=token)
        fact, again = snapshot.plan_fact(got)
        same = next((r for r in had if fact and r["evidence"] == fact), None)
        if same is not None:
            self._accept(step, same["result_id"])
            return Outcome(step.name, got, "reused", reason="files", token=same["result_id"])
        fact = fact or uuid.uuid4().hex
        rid, key = self._claim(step, fact, key)
        self._ran(step, 1)
        data, bad = self._guarded(step, lambda: self._publish(step, rid, key, got, fact, 1, {}, [], path=json.dumps(again) if again else None))
        if bad:
            self._abandon(step, rid, key, RuntimeError(bad.reason))
            return bad
        return Outcome(step.name, data, "published", 1, token=rid)

    def _inputs(self, step: Step, named: dict[str, Step]) -> tuple[dict[str, Outcome], Outcome | None]:
        got = {}
        for n, s in named.items():
            if isinstance(s, Slot) and (state := self.steps.resolution(s.name)[0]) != "bound":
                self._note("misses", self.analysis, self.environment, step.name, None, f"{state}-binding", 1)
                return got, Outcome(step.name, None, "failed", reason=f"{state}-binding: {s.name}")
            got[n] = self.resolve(s)
        bad = next((o for o in got.values() if o.data is None), None)
        if bad is None:
            return got, None
        if bad.state == "failed":
            self._note("misses", self.analysis, self.environment, step.name, None, "child-refused", 1)
        return got, Outcome(step.name, None, bad.state, reason=bad.reason)

    def _reuse_or_run(self, step: Step, fact: str, parts: dict, inputs: list[str], run: Callable[[], DataFrame], key: str | None) -> Outcome:
        had = self.candidates(step)
        match = next((r for r in had if r["evidence"] == fact), None)
        if match is not None:
            self._accept(step, match["result_id"])
            return Outcome(step.name, self.read(match["path"]), "reused", token=match["result_id"])
        misses = self._missed(step, had, parts)
        if not self._admitted(step):
            return Outcome(step.name, None, "pending", reason="execution-required", misses=misses)
        rid, key = self._claim(step, fact, key)
        self._ran(step, 1)
        data, bad = self._guarded(step, lambda: self._publish(step, rid, key, run(), fact, 1, parts, inputs))
        if bad:
            self._abandon(step, rid, key, RuntimeError(bad.reason))
            bad.misses = misses
            return bad
        return Outcome(step.name, data, "published", 1, token=rid, misses=misses)

    def _input_parts(self, step: Step, got: dict[str, Outcome], named: dict[str, Step], columns: dict[str, list[str]]) -> dict:
        """What a step consumed, by part: a digest and the types of the consumed columns of each input."""
        parts = {}
        for n, o in sorted(got.items()):
            child = isinstance(self.steps.bound(named[n]), Source)
            parts[f"{'input' if child else 'child'}:{n}"] = self.columns_digest(o, columns[n])
            parts[f"columns:{n}"] = digest_of(sorted((f.name, f.dataType.simpleString()) for f in o.data.schema.fields if f.name in columns[n]))
        return parts

    def _memo(self, step: Memo, key: str | None) -> Outcome:
        got, bad = self._inputs(step, step.inputs)
        if bad:
            return bad
        parts = {"code": code_digest(step.body, *step.helpers)} | self._input_parts(step, got, step.inputs, step.consumes)
        fact = digest_of(step.name, step.version, parts)
        cut = {n: o.data.select(*step.consumes[n], *step.untracked.get(n, ())) for n, o in got.items()}
        for n, columns in step.untracked.items():
            self.event("untracked", step.name, f"{n}: {', '.join(columns)}")
        return self._reuse_or_run(step, fact, parts, [o.token for o in got.values() if o.token], lambda: step.body(**cut), key)

    def _template(self, step: Template, key: str | None) -> Outcome:
        named = {"_members": step.collection, **{n: s for n, (s, _) in step.inputs.items()}}
        got, bad = self._inputs(step, named)
        if bad:
            return bad
        used = {"_members": got["_members"].data.columns, **{n: list(dict.fromkeys([on, *step.consumes[n]])) for n, (_, on) in step.inputs.items()}}
        code = code_digest(step.body, *step.helpers)
        gated = code_digest(step.gate) if step.gate else ""
        fact = digest_of(step.name, step.version, code, gated, step.key, self._input_parts(step, got, named, used))
        view = next((v for v in reversed(self._mine("views", subject=step.name, version=step.version, environment=self.environment)) if v["fact"] == fact), None)
        if view is not None:
            self._accept(step, view["view_id"])
            return Outcome(step.name, self._view(view), "reused", counts=json.loads(view["counts"]), token=view["view_id"])
        members, bad = self._guarded(step, lambda: keyed.keyed(got["_members"].data, F.col(step.key)))
        if bad:
            bad.reason = f"rejected: {bad.reason}"
            return bad
        members = members.withColumn("_gate", keyed.gate_status(step.gate(members)) if step.gate else F.lit("required"))
        mine = F.sha2(row_token(members, step.consumes["_members"]).cast("binary"), 256) if step.consumes.get("_members") else F.lit("")
        now = members.select("key", mine.alias("_m"), F.when(F.col("_gate") == "required", None).when(F.col("_gate") == "skipped", "skipped").otherwise("failed").alias("_gated"))
        cut = {}
        for n, (_, on) in sorted(step.inputs.items()):
            cut[n] = got[n].data.select(F.col(on).cast("string").alias("key"), *[c for c in step.consumes[n] if c != "key"])
            facts = evidence.key_evidence(cut[n], "key", step.consumes[n]).withColumnRenamed("evidence", f"_{n}")
            now = now.join(facts, "key", "left")
        each = [F.lit(f"{step.name}|{step.version}|{code}"), "_m", *(F.coalesce(F.col(f"_{n}"), F.lit("none")) for n in sorted(step.inputs))]
        mark = F.when(F.col("_gated").isNull(), F.sha2(F.concat_ws("|", *each).cast("binary"), 256))
        had = self.candidates(step)
        held = self._held(had)
        now = now.select("key", mark.alias("evidence"), "_gated")
        have = held.select("key", "evidence", F.lit(True).alias("_have")) if held is not None else None
        index = (now.join(have, ["key", "evidence"], "left") if have is not None else now.withColumn("_have", F.lit(None).cast("boolean"))).persist()
        try:
            stale = index.filter("_gated is null and _have is null").select("key", "evidence")
            n_stale = stale.count()
            denied, fresh, ran = None, None, 0
            if n_stale and not self.write:
                denied, stale = stale, None
            elif n_stale and self.admit:
                ok = self.admit(step.name, stale)
                denied, stale = (stale, None) if ok is False else (stale.join(ok, "key", "left_anti"), stale.join(ok, "key", "left_semi")) if isinstance(ok, DataFrame) else (None, stale)
            if n_stale:
                self._missed(step, had, {}, n_stale) if not had else self._note("misses", self.analysis, self.environment, step.name, had[0]["result_id"], "changed", n_stale)
            if n_stale and stale is not None:
                rid, attempt = self._claim(step, fact, key)

                def work() -> DataFrame:
                    own = members.join(stale.select("key"), "key", "left_semi").select("key", *[c for c in step.consumes.get("_members", []) if c != "key"])
                    rows = step.body(_members=own, **{n: df.join(stale.select("key"), "key", "left_semi") for n, df in cut.items()})
                    state = F.col("status") if "status" in rows.columns else F.lit("succeeded")
                    out = stale.join(rows.withColumn("status", state), "key", "left").withColumn("status", F.coalesce("status", F.lit("failed")))
                    return self._publish(step, rid, attempt, out, fact, n_stale, {}, [o.token for o in got.values() if o.token], {"members": n_stale})

                fresh, bad = self._guarded(step, work)
                if bad:
                    self._abandon(step, rid, attempt, RuntimeError(bad.reason))
                    return bad
                ran = fresh.count()
                self._ran(step, ran)
                had = self.candidates(step)
            held = self._held(had)
            left = index.drop("_have")
            if held is None:
                data = left.select("key", F.coalesce("_gated", F.lit("pending")).alias("status"))
            else:
                data = left.join(held, ["key", "evidence"], "left").withColumn("status", F.coalesce("_gated", "status", F.lit("pending"))).drop("evidence", "_publication", "_gated")
            state = "pending" if denied is not None and not denied.isEmpty() else "published" if ran else "reused"
            if state == "pending" or not self.write:
                return Outcome(step.name, data, state, ran)
            vid = uuid.uuid4().hex
            path = f"views/{step.name}/{vid}"
            left.write.parquet(f"{self.ledger.root}/{path}")
            if len(had) > MERGE_AFTER and held is not None:
                had = self._merge(step, held, had)
            paths = [(r["path"], r["publication"]) for r in self._since_merge(had)]
            view = {"view_id": vid, "path": path, "held": json.dumps(paths), "fact": fact}
            data = self._view(view)
            counts = keyed.readiness(data).counts
            self._note("views", vid, self.analysis, self.environment, step.name, step.version, fact, path, view["held"], json.dumps(counts))
            return Outcome(step.name, data, state, ran, counts=counts, token=vid)
        finally:
            index.unpersist()

    @staticmethod
    def _since_merge(had: list[dict]) -> list[dict]:
        """The publications that hold all retained members: those since the last merge, and the merge."""
        out = []
        for r in had:
            out.append(r)
            if r["evidence"].startswith("merged:"):
                break
        return out

    def _merge(self, step: Template, held: DataFrame, had: list[dict]) -> list[dict]:
        """Writes all retained members as one publication, so that later runs read one table and not one a run."""
        rid, key = self._claim(step, f"merge {had[0]['publication']}", None)
        self._publish(step, rid, key, held.drop("_publication"), f"merged:{rid}", 0, {}, [], {"kind": "merge"})
        return self.candidates(step)

    def _held(self, had: list[dict]) -> DataFrame | None:
        return self._union([(r["path"], r["publication"]) for r in self._since_merge(had)])

    def _union(self, paths: list) -> DataFrame | None:
        """Retained members; the newest publication of each key and evidence."""
        tables = [self.read(p).withColumn("_publication", F.lit(n)) for p, n in paths]
        if not tables:
            return None
        rows = tables[0]
        for t in tables[1:]:
            rows = rows.unionByName(t, allowMissingColumns=True)
        return keyed.latest(rows, ["key", "evidence"], [F.desc("_publication")]) if len(tables) > 1 else rows

    def _view(self, view: dict) -> DataFrame:
        """The members of one population: its index joined to the publications that hold them."""
        index = self.ledger.spark.read.parquet(f"{self.ledger.root}/{view['path']}")
        held = self._union(json.loads(view["held"]))
        if held is None:
            return index.select("key", F.coalesce("_gated", F.lit("pending")).alias("status"))
        return index.join(held, ["key", "evidence"], "left").withColumn("status", F.coalesce("_gated", "status", F.lit("pending"))).drop("evidence", "_publication", "_gated")

    def _fold(self, step: Fold, key: str | None) -> Outcome:
        got = self.resolve(step.over)
        if got.data is None:
            return Outcome(step.name, None, "waiting" if got.state == "pending" else got.state, reason=got.reason)
        ready = keyed.settled(got.counts, outcome=step.outcome) if got.counts else keyed.readiness(got.data, outcome=step.outcome)
        if ready.state != "ready":
            return Outcome(step.name, None, ready.state, counts=ready.counts)
        data = got.data if set(step.consumes) <= set(got.data.columns) else got.data.select("*", *(F.lit(None).alias(c) for c in step.consumes if c not in got.data.columns))
        cut = data.select("key", "status", *step.consumes)
        used = cut if step.outcome else cut.filter("status in ('succeeded', 'skipped')")
        kind = "outcome" if step.outcome else "strict"
        fact_of = lambda name, columns: self.digest(got.token, f"{kind}:{name}:{','.join(sorted(columns))}", lambda: table_digest(used, columns)) if got.token else table_digest(used, columns)
        parts = {"code": code_digest(step.body, *step.helpers), "kind": kind, "membership": fact_of("membership", ["key", "status"]), "members": fact_of("members", used.columns)}
        fact = digest_of(step.name, step.version, parts)
        seen = used if step.outcome else used.filter("status = 'succeeded'")
        out = self._reuse_or_run(step, fact, parts, [got.token] if got.token else [], lambda: step.body(seen), key)
        out.counts = ready.counts
        return out

    def ordinary(self, name: str, work: Callable[[], object]):
        """Work that is observed and not retained."""
        self.event("ordinary-begin", name)
        try:
            out = work()
        except Exception as e:
            self.event("ordinary-failed", name, f"{type(e).__name__}: {e}"[:1000])
            raise
        self.event("ordinary-end", name)
        return out

    # -- other requests -------------------------------------------------------------------
    def recover(self, step: Step, request_key: str) -> str:
        """recovered, absent, incomplete (claimed and never ended) or unsuccessful for a saved request key."""
        had = self.attempts(step, request_key)
        return {"completed": "recovered", "claimed": "incomplete", "abandoned": "unsuccessful"}[had[-1]["state"]] if had else "absent"

    def recovered(self, step: Step, request_key: str) -> DataFrame | None:
        """The rows of the result that a saved request key came to."""
        had = [r for r in self.attempts(step, request_key) if r["state"] == "completed"]
        row = next((r for r in self._mine("results", subject=step.name) if had and r["result_id"] == had[-1]["attempt_id"]), None)
        return self.read(row["path"]) if row else None

    def promote(self, result_ids: list[str], target: str) -> str:
        """Makes results of this analysis visible in another environment, each once."""
        if target == self.environment:
            raise ValueError("a promotion needs another environment")
        if len(set(result_ids)) != len(result_ids):
            raise ValueError("a result is named twice")
        if set(result_ids) - {r["result_id"] for r in self._mine("results")}:
            raise LookupError("an unknown result")
        pid = uuid.uuid4().hex
        self._commit({"promotions": [(pid, self.analysis, target, i, r, self.lease.fence) for i, r in enumerate(result_ids)]}, {"promote": target})
        return pid

    def usage(self) -> Usage:
        return Usage(self.ledger, self.lease, self.environment)


class Workspace:
    """The facade: one ledger folder, one composition."""

    def __init__(self, spark: SparkSession, location: str, analysis: str, *roots: Step, bind: dict[str, Step] | None = None):
        self.ledger = Ledger(spark, location)
        self.steps = Composition(*roots, bind=bind)
        self.analysis = analysis

    def run(self, environment: str = "main", admit=None, **options) -> Run:
        """``wait``: how long to wait for a held ledger, in ms; ``ttl``: how long the writer's lease outlasts a lost driver."""
        return Run(self.ledger, self.steps, self.analysis, environment, admit, **options)

    def check(self, step: Step, environment: str = "main") -> Outcome:
        """Says what a run would do, and writes nothing."""
        return Run(self.ledger, self.steps, self.analysis, environment, write=False).resolve(step)

    def check_members(self, step: Template, environment: str = "main") -> DataFrame:
        """(key, state): reusable, execution-required, skipped or failed for each member; uncertain while its population is."""
        out = self.check(step, environment)
        if out.data is None:
            return self.ledger.spark.createDataFrame([], "key string, state string")
        state = F.when(F.col("status") == "pending", "execution-required").when(F.col("status").isin("skipped", "failed"), F.col("status")).otherwise("reusable")
        return out.data.select("key", state.alias("state"))

    def preview(self, step: Step, environment: str = "main") -> tuple[str, DataFrame | None]:
        """The newest retained result, and whether it is current, stale, refresh-failed or unavailable."""
        run = Run(self.ledger, self.steps, self.analysis, environment, write=False)
        had = run.candidates(step)
        if not had:
            return "unavailable", None
        got = self.check(step, environment)
        last = run._mine("attempts", subject=step.name, environment=environment)
        stale = "refresh-failed" if last and last[-1]["state"] == "abandoned" else "stale"
        return ("current" if got.state == "reused" else stale), run.read(had[0]["path"])
