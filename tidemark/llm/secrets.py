"""Secret scans by one combined deterministic automaton.

The rules' expressions become one NFA, subset construction and minimisation turn it into
transition arrays over byte classes, and one pass over the bytes of a text runs all rules.
The automaton tells where matches end; a small reversed automaton of the rule, run backwards
from there, gives the leftmost start that the rule's previous match leaves free.

Every rule ends in a greedy run of one character class, so a match ends where acceptance
does. Null and empty texts have no spans; long texts are scanned whole; repeated rows and
rows without an id are scanned each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import freed, text_docs

#: (kind, expression, least length of the span, least length of an assigned value). The first
#: three are the base kinds. Counted minima inside an unanchored rule multiply states, so all
#: but the run of hex digits, which can't restart, are checked on the span that was found.
#: A further rule that ends in a run of letters and digits doubles the states.
RULES = (
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", 0, 6),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
    ("github", r"gh[opsur]_[A-Za-z0-9]+", 40, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, 0),
    ("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x0a\x0d]+", 60, 0),
)
BASE = 3
_VALUE = re.compile(r"[A-Za-z]+_?[A-Za-z]*[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


class _Parser:
    """Literals, classes, groups, |, ?, *, +, {m}, {m,} and {m,n} to a small syntax tree."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def alternation(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        items = []
        while self.peek() and self.peek() not in "|)":
            items.append(self.repeat())
        return ("seq", items)

    def repeat(self):
        item = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.at += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[c]
            if c == "{":
                body, _, rest = self.text[self.at :].partition("}")
                self.at = len(self.text) - len(rest)
                a, comma, b = body.partition(",")
                low, high = int(a), (int(b) if b else None) if comma else int(a)
            item = ("rep", item, low, high)
        return item

    def atom(self):
        c = self.peek()
        self.at += 1
        if c == "(":
            inner = self.alternation()
            self.at += 1
            return inner
        if c == "[":
            return ("set", self.members())
        return ("set", {self.escaped() if c == "\\" else ord(c)})

    def escaped(self) -> int:
        c = self.peek()
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def members(self) -> set[int]:
        out: set[int] = set()
        while (c := self.peek()) != "]":
            self.at += 1
            low = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                d = self.peek()
                self.at += 1
                out.update(range(low, (self.escaped() if d == "\\" else ord(d)) + 1))
            else:
                out.add(low)
        self.at += 1
        return out


def parse(expression: str):
    return _Parser(expression).alternation()


def mirrored(tree):
    kind = tree[0]
    if kind == "seq":
        return ("seq", [mirrored(x) for x in reversed(tree[1])])
    if kind == "or":
        return ("or", [mirrored(x) for x in tree[1]])
    return ("rep", mirrored(tree[1]), *tree[2:]) if kind == "rep" else tree


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def build(self, tree, start: int) -> int:
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((frozenset(tree[1]), end))
            return end
        if kind == "seq":
            for x in tree[1]:
                start = self.build(x, start)
            return start
        if kind == "or":
            end = self.state()
            for x in tree[1]:
                self.free[self.build(x, start)].append(end)
            return end
        _, inner, low, high = tree
        for _ in range(low):
            start = self.build(inner, start)
        if high is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.build(inner, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(high - low):
            self.free[start].append(end)
            start = self.build(inner, start)
        self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Automaton:
    """Transition arrays over byte classes; ``accepts[s]`` is a bit mask of rules.

    ``floating``: a match may start at any byte, else only at the first.
    States are multiples of the number of classes; those that accept come last.
    """

    def __init__(self, trees: list, floating: bool):
        nfa = _Nfa()
        root = nfa.state()
        ends = {}
        for i, tree in enumerate(trees):
            first = nfa.state()
            nfa.free[root].append(first)
            ends[nfa.build(tree, first)] = 1 << i
        groups: dict[tuple, list[int]] = {}
        sets = sorted({s for m in nfa.moves for s, _ in m}, key=sorted)
        for b in range(256):
            groups.setdefault(tuple(b in s for s in sets), []).append(b)
        classes = list(groups.values())
        self.classes = bytes(next(i for i, g in enumerate(classes) if b in g) for b in range(256))
        start = nfa.closure([root])
        number, rows, accept = {start: 0}, [], []
        todo = [start]
        for states in todo:
            accept.append(sum({ends[s] for s in states if s in ends}))
            row = []
            for group in classes:
                to = {t for s in states for chars, t in nfa.moves[s] if group[0] in chars}
                to = nfa.closure(to | ({root} if floating else set()))
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        block = self._minimised(rows, accept)
        count = max(block) + 1
        pick = [block.index(i) for i in range(count)]
        order = sorted(range(count), key=lambda i: (accept[pick[i]] != 0, i != block[0]))
        place = {b: i for i, b in enumerate(order)}
        n = self.width = len(classes)
        self.table = [place[block[t]] * n for b in order for t in rows[pick[b]]]
        self.accepts = {place[b] * n: accept[pick[b]] for b in order}
        self.first_accepting = n * sum(accept[pick[b]] == 0 for b in order)
        self.start = place[block[0]] * n
        dead = [s for s in self.accepts if not self.accepts[s] and all(self.table[s + c] == s for c in range(n))]
        self.dead = dead[0] if dead and not floating else -1

    @staticmethod
    def _minimised(rows: list[list[int]], accept: list[int]) -> list[int]:
        """Partition refinement: states are told apart by acceptance, then by where they lead."""
        block = accept
        while True:
            ids: dict[tuple, int] = {}
            new = [ids.setdefault((block[s], *(block[t] for t in row)), len(ids)) for s, row in enumerate(rows)]
            if len(ids) == len(set(block)):
                return new
            block = new


@lru_cache(maxsize=4)
def scanner(rules=RULES):
    trees = [parse(r[1]) for r in rules]
    return Automaton(trees, floating=True), [Automaton([mirrored(t)], floating=False) for t in trees]


def scan(data: bytes, rules=RULES) -> list[tuple[int, int, int]]:
    """(start, rule, end) of all spans in bytes, ordered."""
    forward, backward = scanner(rules)
    table, edge, state = forward.table, forward.first_accepting, forward.start
    hits = []
    at = 0
    for c in data.translate(forward.classes):
        state = table[state + c]
        if state >= edge:
            hits.append((at, state))
        at += 1
    if not hits:
        return []
    out = []
    for r, (_, _, least, least_value) in enumerate(rules):
        bit, taken = 1 << r, 0
        ends = [i for i, s in hits if forward.accepts[s] & bit]
        back = backward[r]
        for k, i in enumerate(ends):
            if k + 1 < len(ends) and ends[k + 1] == i + 1:
                continue
            s, p, first = back.start, i, -1
            while p >= taken:
                s = back.table[s + back.classes[data[p]]]
                if s == back.dead:
                    break
                if s >= back.first_accepting:
                    first = p
                p -= 1
            if first < 0:
                continue
            taken = i + 1
            if i + 1 - first < least or least_value and len(_VALUE.match(data[first : i + 1].decode("ascii"))[1]) < least_value:
                continue
            out.append((first, r, i + 1))
    return sorted(out)


def spans(text: str | None, rules=RULES) -> list[tuple[int, int, int]]:
    """The spans in code points."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    found = scan(data, rules)
    if len(data) == len(text) or not found:
        return found
    places, at, chars = {}, 0, 0
    for b in sorted({b for s, _, e in found for b in (s, e)}):
        chars += len(data[at:b].decode("utf-8", "surrogatepass"))
        places[b], at = chars, b
    return [(places[s], r, places[e]) for s, r, e in found]


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every maximal chain of overlapping spans replaced."""
    out, at = [], 0
    for s, _, e in spans(text):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:] if out else text


def _told(found) -> str:
    return ",".join(f"{RULES[r][0]}:{s}:{e}" for s, r, e in found)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [spans(t.as_py()) for t in batch.column(1)]
        base = [[x for x in f if x[1] < BASE] for f in found]
        count = lambda r: pa.array([sum(x[1] == r for x in f) for f in base], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), count(0), count(1), count(2), pa.array([hashlib.sha256(_told(f).encode()).hexdigest() for f in base], pa.string()), pa.array([_told(f) for f in found], pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def secrets(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of every text."""
    return text_docs(docs).mapInArrow(_rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` replaced; all columns stay."""

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array([redact(t.as_py()) for t in batch.column(i)], batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)


__all__ = ["BASE", "RULES", "Automaton", "parse", "redact", "redacted", "scan", "secrets", "spans"]
