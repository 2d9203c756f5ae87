"""Declarations and the frozen composition they form."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from .identity import code_digest


@dataclass(frozen=True, eq=False)
class Step:
    name: str
    version: str = field(default="1", kw_only=True)

    @property
    def children(self) -> tuple[Step, ...]:
        return ()


@dataclass(frozen=True, eq=False)
class Source(Step):
    """``run(previous)`` returns a DataFrame, or None to retain the previous result."""

    run: Callable[[DataFrame | None], DataFrame | None]
    finality: Callable[[DataFrame], bool] | None = None


@dataclass(frozen=True, eq=False)
class Memo(Step):
    """A retained computation: ``body(**inputs)`` sees only the columns it consumes."""

    inputs: dict[str, Step]
    consumes: dict[str, list[str]]
    body: Callable[..., DataFrame]
    helpers: tuple[Callable, ...] = ()
    #: Columns that the body sees beside those it consumes and that are no evidence; each use is an event of the run.
    untracked: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def children(self):
        return tuple(self.inputs.values())


@dataclass(frozen=True, eq=False)
class Template(Step):
    """One keyed plan for all members of a collection.

    ``inputs`` are keyed tables (name to step and key column); the body gets them cut to the
    members to compute and returns rows with a column ``key``, one a member.
    """

    collection: Step
    key: str
    inputs: dict[str, tuple[Step, str]]
    consumes: dict[str, list[str]]
    body: Callable[..., DataFrame]
    gate: Callable[[DataFrame], Column] | None = None
    gate_consumes: tuple[str, ...] = ()
    helpers: tuple[Callable, ...] = ()

    @property
    def children(self):
        return (self.collection, *(s for s, _ in self.inputs.values()))


@dataclass(frozen=True, eq=False)
class Fold(Step):
    """An aggregate over the members of a template: strict, or over outcomes."""

    over: Template
    consumes: list[str]
    body: Callable[[DataFrame], DataFrame]
    outcome: bool = False
    helpers: tuple[Callable, ...] = ()

    @property
    def children(self):
        return (self.over,)


@dataclass(frozen=True, eq=False)
class Slot(Step):
    """A step supplied by name when the composition is formed; what is bound to it is evidence like any step."""


class Composition:
    """Steps by name, each once, with all children included and no cycle. ``bind``: the steps that slots stand for."""

    def __init__(self, *roots: Step, bind: dict[str, Step | tuple[Step, ...]] | None = None):
        self.bind = {k: v if isinstance(v, tuple) else (v,) for k, v in (bind or {}).items()}
        self.steps: dict[str, Step] = {}
        self.order: list[Step] = []
        self.edges: set[tuple[str, str]] = set()
        for r in roots:
            self._add(r, ())

    def _add(self, step: Step, above: tuple[Step, ...]) -> None:
        if isinstance(step, Slot):
            state, bound = self.resolution(step.name)
            if state != "bound":
                return
            step = bound
        if step in above:
            raise ValueError(f"{step.name} depends on itself")
        had = self.steps.get(step.name)
        if had is step:
            return
        if had is not None:
            raise ValueError(f"two steps are named {step.name}")
        for c in step.children:
            self.edges.add((step.name, c.name))
            self._add(c, (*above, step))
        self.steps[step.name] = step
        self.order.append(step)

    def resolution(self, name: str) -> tuple[str, Step | int | None]:
        """("bound", the step), ("missing", None), or ("ambiguous", how many are bound); never guessed."""
        found = self.bind.get(name, ())
        if not found and name in self.steps:
            return "bound", self.steps[name]
        return ("bound", found[0]) if len(found) == 1 else ("ambiguous", len(found)) if found else ("missing", None)

    def bound(self, step: Step) -> Step:
        if not isinstance(step, Slot):
            return step
        state, found = self.resolution(step.name)
        if state != "bound":
            raise LookupError(f"slot {step.name} is {state}")
        return found

    def resolve_name(self, name: str) -> Step:
        """The step of that name; a missing one is an error, never guessed."""
        if name not in self.steps:
            raise LookupError(f"no step is named {name}")
        return self.steps[name]

    def reconnect(self, witness: str) -> tuple[Step, Step]:
        """The current parent and child of a recorded call; its edge must still be declared."""
        kind, version, parent, child = json.loads(witness)
        if (kind, version) != ("call", 1):
            raise ValueError("the witness has another format")
        if (parent, child) not in self.edges:
            raise LookupError(f"{parent} no longer calls {child}")
        state, found = self.resolution(child)
        if state != "bound":
            raise LookupError(f"{child} is {state}")
        return self.resolve_name(parent), found

    def witness(self, parent: str, child: str) -> str:
        """The record of a call by the names of its ends."""
        if (parent, child) not in self.edges:
            raise LookupError(f"{parent} does not call {child}")
        return json.dumps(["call", 1, parent, child])

__all__ = ["Composition", "Fold", "Memo", "Slot", "Source", "Step", "Template", "code_digest"]
