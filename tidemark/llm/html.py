"""Main text of web pages by minimum-cut labelling.

A page becomes a list of text blocks with the path of elements above each. A fixed linear
classifier over path, length, links and wording gives every block a cost for either label;
the costs are terminal capacities, and neighbours in page order and blocks under the same
element are tied by smoothness edges. The minimum cut separates content from boilerplate.

A null or empty page, and one whose blocks are all boilerplate, has the empty text. Broken
markup (unclosed or stray tags, unterminated comments) never raises, and an element that is
never closed doesn't silence the rest of its page (scripts and styles do, as in browsers).
Pages are independent: repeated rows and repeated ids give repeated results, an empty table
none, other columns are not read, and a page of any length or depth is read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>?", re.DOTALL)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select textarea option datalist title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: Raw elements that run to the page's end if they are not closed.
UNENDING = frozenset(("script", "style"))
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul label input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_P_OPEN = frozenset("button label input".split())
CHROME = {"nav": -9, "footer": -9, "header": -7, "aside": -8, "form": -8, "menu": -8, "dialog": -8, "button": -9, "label": -6, "fieldset": -6, "search": -8, "address": -3}
_BAD = re.compile(r"(?:^|[\s_-])(nav|navbar|navigation|menu|sidebar|side|footer|foot|header|masthead|banner|ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|breadcrumbs?|comments?|replies|reply|disqus|pagination|pager|popup|modal|overlay|widget|toolbar|legal|copyright|skip|search|tags|hidden)(?=$|[\s_-]|\d)")
_GOOD = re.compile(r"(?:^|[\s_-])(article|main|content|post|entry|story|body|text)(?=$|[\s_-]|\d)")
_FORMAL = re.compile(r"©|\(c\)\s*\d{4}|copyright|all rights reserved|cookies?\b|privacy policy|terms of (?:use|service)|subscribe|sign (?:up|in)|log in|advertisement|click here", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class _Element:
    __slots__ = ("tag", "bias", "article", "hard", "level", "parent")

    def __init__(self, tag, bias, article, hard, parent):
        self.tag, self.bias, self.article, self.hard, self.parent = tag, bias, article, hard, parent
        self.level = parent.level + 1 if parent else 0


def _element(tag: str, attrs: str, parent: _Element) -> _Element:
    """What stands above a block: the sum of its elements' evidence."""
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(attrs)} if attrs.strip() else {}
    names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".lower()
    article = parent.article or tag in ("article", "main") or found.get("role", "").lower() in ("main", "article")
    bias, hard = parent.bias, parent.hard
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "").lower()):
        hard = True
    role = {"navigation": "nav", "contentinfo": "footer", "banner": "header", "complementary": "aside", "search": "search", "dialog": "dialog", "form": "form", "alert": "dialog"}.get(found.get("role", "").lower(), tag)
    if role in CHROME and not (role == "header" and parent.article):
        bias += CHROME[role]
    if tag in ("article", "main") and not parent.article:
        bias += 5
    if names.strip() and tag not in ("html", "body"):
        if _BAD.search(names):
            bias -= 8
        elif _GOOD.search(names):
            bias += 3
    return _Element(tag, bias, article, hard, parent)


class Block:
    """A text, the element that holds it, and how many of its characters are links."""

    __slots__ = ("text", "top", "linked", "cost")

    def __init__(self, text, top, linked):
        self.text, self.top, self.linked = text, top, linked
        self.cost = 0.0


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, white space collapsed, character references decoded.

    A silent element ends with its end tag or with that of an element it lies in; one whose end tag never
    comes is no element at all, so that it can't silence the rest of the page.
    """
    root = _Element("", 0, False, False, None)
    stack, out, text, linked = [root], [], [], 0
    in_link, silent, at = False, None, 0
    open_tags: Counter = Counter()  # of the stack
    inner: Counter = Counter()  # opened within the silent element
    lower, last_end = page.lower(), {}

    def closes(tag: str) -> bool:
        if tag not in last_end:
            last_end[tag] = lower.rfind(f"</{tag}")
        return last_end[tag] >= at

    def flush():
        nonlocal linked
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                out.append(Block(joined, stack[-1], linked))
            text.clear()
        linked = 0

    def put(piece: str):
        nonlocal linked
        text.append(piece)
        if in_link:
            linked += len(piece.strip())

    def end(tags):
        if not any(open_tags[t] for t in tags):
            return
        while True:
            tag = stack.pop().tag
            open_tags[tag] -= 1
            if tag in tags:
                return

    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            if silent is None:
                put(page[at:])
            break
        if silent is None and m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA[") and silent is None:
                put(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing, attrs = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if silent is not None:
            if not closing:
                if tag in BLOCK and tag not in VOID:
                    inner[tag] += 1
                continue
            if tag == silent:
                silent = None
                continue
            if inner[tag]:
                inner[tag] -= 1
                continue
            if not open_tags[tag]:
                continue
            silent = None
        if tag in SILENT:
            if tag == "option" or closing or attrs.endswith("/") and tag not in RAW:
                continue
            if tag in RAW:
                at = _past(page, at, tag) if closes(tag) else len(page) if tag in UNENDING else _next_tag(page, at)
            elif closes(tag):
                silent = tag
                inner.clear()
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag == "br":
            put(" ")
            continue
        if tag not in BLOCK:
            continue
        flush()
        in_link = False
        if closing:
            end({tag})
            continue
        if tag not in KEEPS_P_OPEN and stack[-1].tag == "p":
            end({"p"})
        if tag in ENDS and stack[-1].tag in ENDS[tag]:
            end(ENDS[tag])
        if tag not in VOID:
            stack.append(_element(tag, attrs, stack[-1]))
            open_tags[tag] += 1
    flush()
    return out


def _next_tag(page: str, at: int) -> int:
    """Where the next tag begins, or the page's end."""
    found = page.find("<", at)
    return len(page) if found < 0 else found


def _past(page: str, at: int, tag: str) -> int:
    """Behind the end tag of a raw element, or the page's end."""
    m = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
    return m.end() if m else len(page)


def classify(found: list[Block]) -> None:
    """cost > 0: the evidence for content, < 0: for boilerplate, in nats."""
    for b in found:
        top = b.top
        words = b.text.count(" ") + 1
        cost = -0.8 + top.bias + min(words, 40) * 0.06
        if top.tag in ("p", "pre", "blockquote", "h1", "h2", "h3"):
            cost += 0.8
        if b.text[-1] in ".!?…:;\"”»":
            cost += 0.6
        share = b.linked / max(len(b.text), 1)
        if share > 0.5:
            cost -= 3 if words < 15 else 1.5
        if _FORMAL.search(b.text) and words < 30 and not top.article:
            cost -= 2.5
        b.cost = -1000.0 if top.hard else cost


def _tie(a: Block, b: Block) -> float:
    """Smoothness of neighbours: strong under one element, weak across the page."""
    x, y = a.top, b.top
    depth = max(x.level, y.level) + 1
    while x is not y:  # up to the innermost element that holds both
        if x.level >= y.level:
            x, y = x.parent, y
        else:
            y = y.parent
    return 1.2 * ((x.level + 1) / depth) ** 2


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut.

    Positive costs are capacities from the source, negative ones to the sink. Flow is pushed
    level by level (Dinic) between the two kinds until no path with capacity is left.
    """
    n = len(costs)
    to: list[int] = []
    room: list[float] = []
    graph: list[list[int]] = [[] for _ in range(n)]
    for a, b, c in edges:
        graph[a].append(len(to))
        to.append(b)
        room.append(c)
        graph[b].append(len(to))
        to.append(a)
        room.append(c)
    spare = [max(c, 0.0) for c in costs]
    need = [max(-c, 0.0) for c in costs]
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if spare[i] > 1e-9)
        for i in queue:
            level[i] = 0
        goal = False
        while queue:
            u = queue.popleft()
            goal |= need[u] > 1e-9
            for e in graph[u]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if not goal:
            return [x >= 0 for x in level]
        place = [0] * n
        for s in range(n):
            while spare[s] > 1e-9:
                path, u = [], s
                while True:
                    if need[u] > 1e-9:
                        push = min([spare[s], need[u], *(room[e] for e in path)])
                        spare[s] -= push
                        need[u] -= push
                        for e in path:
                            room[e] -= push
                            room[e ^ 1] += push
                        break
                    while place[u] < len(graph[u]) and not (room[graph[u][place[u]]] > 1e-9 and level[to[graph[u][place[u]]]] == level[u] + 1):
                        place[u] += 1
                    if place[u] < len(graph[u]):
                        e = graph[u][place[u]]
                        path.append(e)
                        u = to[e]
                    elif path:
                        u = to[path.pop() ^ 1]
                        place[u] += 1
                    else:
                        u = -1
                        break
                if u < 0:
                    break


def extract(page: str | None) -> str:
    """The article's text: its blocks joined by two line feeds."""
    if not page:
        return ""
    found = blocks(page)
    if not found:
        return ""
    classify(found)
    side = min_cut([b.cost for b in found], ties(found))
    return "\n\n".join(b.text for b, keep in zip(found, side, strict=True) if keep)


def ties(found: list[Block]) -> list[tuple[int, int, float]]:
    """The smoothness edges: neighbours in page order, and the next block under the same element."""
    edges = [(i, i + 1, _tie(found[i], found[i + 1])) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        k = id(b.top.parent if b.top.tag == "p" or b.top.level > 1 else b.top)
        if k in last and last[k] < i - 1:
            edges.append((last[k], i, 0.6))
        last[k] = i
    return edges


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "html", 1 << 22):
            texts = [extract(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its code points of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_rows, "page_id long, url string, text string, n_chars long")
