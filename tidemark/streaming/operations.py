"""Operations with retry: a driver-side state machine whose every step is a journal revision.

A send is journalled before it happens, so a crash leaves it as possibly sent and a later
run settles it instead of repeating it. Side effects belong here, never into tasks that
Spark may run twice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

HISTORY = 8


class RateLimited(RuntimeError):
    """The remote side asks to come later."""


@dataclass(frozen=True)
class Decision:
    """retry (not before an instant), or give up."""

    retry: bool
    not_before: int = 0


def default_policy(attempt: int, error: str, history: list[dict], now: int, most: int = 5) -> Decision:
    return Decision(False) if attempt >= most else Decision(True, now + min(60_000, 2_000 * 2 ** (attempt - 1)))


@dataclass
class Operation:
    key: str
    status: str = "new"
    attempts: list[dict] = field(default_factory=list)
    not_before: int = 0
    value: str | None = None
    revision: int = 0


class Operations:
    def __init__(self, ledger, lease, collection: str = "operations", clock: Callable[[], int] = lambda: int(time.time() * 1000)):
        self.ledger, self.lease, self.collection, self.clock = ledger, lease, collection, clock

    def get(self, key: str) -> Operation:
        row = self.ledger.journal().get((self.collection, key))
        return Operation(**json.loads(row["content"]), revision=row["revision"]) if row else Operation(key)

    def inspect(self, *statuses: str) -> list[Operation]:
        """All operations, or those in some states, by key."""
        rows = sorted((k, r) for (c, k), r in self.ledger.journal().items() if c == self.collection)
        found = [Operation(**json.loads(r["content"]), revision=r["revision"]) for _, r in rows]
        return [o for o in found if not statuses or self.state(o) in statuses]

    def state(self, op: Operation) -> str:
        """One of the nine states that an operator sees."""
        if op.status == "waiting":
            return "due" if op.not_before <= self.clock() else "rate-limited" if op.attempts and op.attempts[-1].get("limited") else "waiting"
        return op.status  # new, sending, unsettled, succeeded, failed or abandoned

    def _put(self, op: Operation) -> None:
        content = {k: v for k, v in op.__dict__.items() if k != "revision"}
        if not self.ledger.journal_commit(self.lease, self.collection, {op.key: (op.revision, json.dumps(content))}):
            raise RuntimeError(f"{op.key} was changed by another")
        op.revision += 1

    def passes(self, work: dict[str, Callable[[], str]], policy=default_policy, sleep: Callable[[float], None] | None = time.sleep, stop: StopController | None = None) -> int | None:
        """Runs operations pass after pass until none waits; returns None, or, without ``sleep`` or once stopped, the instant at which to come again."""
        while True:
            ops = [self.run(k, f, policy) for k, f in work.items() if stop is None or stop.now() == "none"]
            late = [o.not_before for o in ops if o.status == "waiting"]
            if stop is not None and stop.now() != "none":
                return min(late, default=self.clock())
            if not late:
                return None
            if sleep is None:
                return min(late)
            if not self.sleep_until(min(late), sleep, stop):
                return min(late)

    def sleep_until(self, at: int, sleep: Callable[[float], None] = time.sleep, stop: StopController | None = None, step: int = 1000) -> bool:
        """Waits until an instant in short steps; False if it was stopped. Runs on the driver, so that no task is held."""
        while (now := self.clock()) < at:
            if stop is not None and stop.now() != "none":
                return False
            sleep(min(step, at - now) / 1000)
        return True

    def send(self, key: str, request: Callable[[], str], pool: PermitPool, stop: StopController | None = None, usage=None) -> Operation:
        """One guarded send: refused once stopped, under a permit, its intent recorded before it and its outcome after."""
        if stop is not None and stop.now() != "none":
            return self.get(key)
        if not pool.acquire(key):
            return self.get(key)
        try:
            if usage is not None:
                usage.record_intent(key, str(len(self.get(key).attempts) + 1))
            return self.run(key, request)
        finally:
            pool.release()

    def run(self, key: str, perform: Callable[[], str], policy=default_policy) -> Operation:
        """One pass: the operation ends as succeeded, failed, waiting or unsettled."""
        op = self.get(key)
        if op.status in ("succeeded", "failed", "abandoned"):
            return op
        if op.status == "sending":
            op.status = "unsettled"
            self._put(op)
            return op
        if op.status == "unsettled" or op.not_before > self.clock():
            return op
        op.status = "sending"
        op.attempts.append({"n": len(op.attempts) + 1, "at": self.clock()})
        self._put(op)
        try:
            op.value, op.status = perform(), "succeeded"
        except Exception as e:
            op.attempts[-1]["error"] = str(e)
            known = [a.get("not_before", 0) for a in op.attempts]
            op.attempts[-1]["limited"] = isinstance(e, RateLimited)
            d = policy(len(op.attempts), str(e), op.attempts[-HISTORY - 1 : -1], self.clock())
            op.status, op.not_before = ("waiting", max([d.not_before, *known])) if d.retry else ("failed", 0)
            op.attempts[-1]["not_before"] = op.not_before
        self._put(op)
        return op

    def settle(self, key: str, resolve: str | None = None) -> Operation:
        """An operator's word on an unsettled operation: its value, or abandoned."""
        op = self.get(key)
        if op.status not in ("unsettled", "waiting", "sending"):
            raise ValueError(f"{key} is {op.status}")
        op.status, op.value = ("succeeded", resolve) if resolve is not None else ("abandoned", None)
        self._put(op)
        return op


class PermitPool:
    """Permits handed out first come, first served within a priority."""

    def __init__(self, size: int = 1):
        self.free, self.waiting, self.count = size, [], 0

    def acquire(self, name: str, priority: int = 0) -> bool:
        if self.free and not self.waiting:
            self.free -= 1
            return True
        self.count += 1
        self.waiting.append((-priority, self.count, name))
        self.waiting.sort()
        return False

    def cancel(self, name: str) -> bool:
        before = len(self.waiting)
        self.waiting = [w for w in self.waiting if w[2] != name]
        return len(self.waiting) < before

    def release(self) -> str | None:
        """The next holder, if any waits."""
        if self.waiting:
            return self.waiting.pop(0)[2]
        self.free += 1
        return None


class StopController:
    """none, then soft (finish what runs), then hard; never back."""

    ORDER = ("none", "soft", "hard")

    def __init__(self, clock: Callable[[], int] = lambda: int(time.time() * 1000)):
        self.level, self.deadline, self.clock = "none", None, clock

    def stop(self, level: str = "soft", grace: int | None = None) -> None:
        if self.ORDER.index(level) > self.ORDER.index(self.level):
            self.level = level
        if grace is not None and level == "soft":
            self.deadline = self.clock() + grace

    def now(self) -> str:
        if self.level == "soft" and self.deadline is not None and self.clock() >= self.deadline:
            self.level = "hard"
        return self.level


def dispatch(members: dict[str, Callable[[], object]], window: int = 8, stop: StopController | None = None) -> dict[str, tuple[str, object]]:
    """Runs calls to remote sides, at most ``window`` at once, started in canonical key order; an error stays with its member.

    (state, value or error) of each: succeeded, failed, or not-started after a stop. For driver-side work alone: data goes through plans."""
    from concurrent.futures import ThreadPoolExecutor

    def one(body):
        if stop is not None and stop.now() != "none":
            return "not-started", None
        try:
            return "succeeded", body()
        except Exception as e:
            return "failed", e

    keys = sorted(members, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    with ThreadPoolExecutor(window) as pool:
        return dict(zip(keys, pool.map(lambda k: one(members[k]), keys), strict=True))
