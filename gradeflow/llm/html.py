"""Main text of web pages by wrapper induction.

Pages of one host are made from one template.  The trees of a few distinct pages
per host are aligned by simple tree matching; a text that is the same at a node
in all of them belongs to the template, a varying slot holds content.  Every page
is then aligned with its host's wrapper, and the text of the content region without page
furniture is its main text.  In a region the page marks as its article a text
that pages share is still the article's; elsewhere shared texts are template.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.llm.common import sieved, steps

#: Distinct pages of a host that its wrapper is induced from at most (a bounded sample; every page is aligned).
SAMPLE = 8
#: A text is template if it is the same in at least so many distinct pages.
CONSTANT_PAGES = 3
#: A node that only its class words, or a form tag, call furniture is none if it holds this share of the page's text.
MOST_TEXT = 0.9

# HTML tags by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("head nav footer aside form script style noscript button select option textarea input iframe svg canvas template dialog title xmp noembed noframes object".split())
WORDS_OF_FURNITURE = frozenset(
    "nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement banner cookie cookies consent gdpr notice promo promoted sponsor sponsored "
    "comment comments disqus share sharing social related breadcrumb breadcrumbs subscribe newsletter login signup popup modal widget skip pagination masthead topbar toolbar".split()
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPES = frozenset("ul ol dl table select body html article section div main td th".split())
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "li", "dt", "dd", "legend", "summary"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]++|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|style|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "label", "kids", "furniture", "main", "runs", "hinted")

    def __init__(self, tag: str, label: str, furniture: bool, main: bool, hinted: bool = False):
        self.tag, self.label, self.furniture, self.main, self.hinted = tag, label, furniture, main, hinted
        self.kids: list = []  # nodes and strings
        self.runs = None


@lru_cache(20_000)
def _kind(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Label of a tag (name and class words), whether it is page furniture, marked as the main part, and furniture by a hint only."""
    found = {m[0].lower(): next((x for x in m[1:] if x), "") for m in _ATTRIBUTE.findall(attributes)} if attributes else {}
    names = _TOKEN.findall(" ".join(found.get(k, "") for k in ("class", "id", "role")).lower())
    hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
    sure = tag in FURNITURE and tag != "form" or hidden
    hinted = not sure and tag not in ("html", "body") and (tag == "form" or any(n in WORDS_OF_FURNITURE for n in names))
    whole = tag == "main" or "main" in found.get("role", "")
    main = not sure and whole or not sure and not hinted and (tag == "article" or "articlebody" in found.get("itemprop", "").lower())
    return f"{tag}.{'.'.join(sorted(set(_TOKEN.findall(found.get('class', '').lower()))))}", sure or hinted, main, hinted


def parse(html: str) -> Node:
    """The tree of a page, forgiving as browsers are: open elements end where their parents or successors do."""
    root = Node("html", "html.", False, False)
    stack, at, low = [root], 0, None
    while True:
        m = _TAG.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            stack[-1].kids.append(text)
        if not m:
            return _weighed(root)
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag == "html" or tag == "body" and any(n.tag == "body" for n in stack):
            continue
        ends = CLOSED_BY.get(tag) or ({"p"} if tag in ENDS_P else None)
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES:
                    break
        node = Node(tag, *_kind(tag, m[3]))
        stack[-1].kids.append(node)
        if tag in RAW:
            low = low or html.lower()
            end = low.find(f"</{tag}", at)
            at = len(html) if end < 0 else end
            if tag == "textarea" or end < 0:
                continue
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)


def _weighed(root: Node) -> Node:
    """The tree, where hints of furniture are dropped at nodes that hold the main part or ``MOST_TEXT`` of the text."""
    nodes, up, k = [root], [0], 0
    while k < len(nodes):
        for kid in nodes[k].kids:
            if isinstance(kid, Node) and (kid.hinted or not kid.furniture):
                nodes.append(kid)
                up.append(k)
        k += 1
    if any(n.hinted for n in nodes):
        sizes = [sum(len(kid.strip()) for kid in n.kids if isinstance(kid, str)) for n in nodes]
        holds = [n.main and n.tag != "article" for n in nodes]
        for k in range(len(nodes) - 1, 0, -1):
            sizes[up[k]] += sizes[k]
            holds[up[k]] = holds[up[k]] or holds[k]
        for k, n in enumerate(nodes):
            if n.hinted and (holds[k] or sizes[k] >= MOST_TEXT * sizes[0]):
                n.furniture = False
    return root


def _deep(walk: Iterator) -> None:
    """Run a walk that yields the walks below it, on a stack of its own: pages may be nested to any depth."""
    stack = [walk]
    while stack:
        below = next(stack[-1], None)
        if below is None:
            stack.pop()
        else:
            stack.append(below)


def runs(node: Node) -> list[tuple[str, list[Node]]]:
    """Children in order, neighbours of one label together (a list of any length is one slot)."""
    if node.runs is None:
        node.runs = []
        for kid in node.kids:
            if isinstance(kid, Node) and kid.tag in BLOCK:
                if node.runs and node.runs[-1][0] == kid.label:
                    node.runs[-1][1].append(kid)
                else:
                    node.runs.append((kid.label, [kid]))
    return node.runs


def text_of(node: Node, linked: bool | None = None) -> str:
    """All text below a node but that of furniture; ``linked`` True: only that of links."""
    out: list[str] = []
    stack = [(iter(node.kids), node.tag == "a")]
    while stack:
        kids, inside = stack[-1]
        for kid in kids:
            if isinstance(kid, str):
                if inside or not linked:
                    out.append(kid)
            elif not kid.furniture:
                stack.append((iter(kid.kids), inside or kid.tag == "a"))
                break
        else:
            stack.pop()
    return " ".join(unescape(" ".join(out)).split())


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 11


class Slot:
    """A node of a wrapper: the run of page nodes that align with it."""

    def __init__(self, label: str):
        self.label, self.pages, self.chars, self.links, self.main, self.furniture = label, 0, 0, 0, False, False
        self.constant: set[int] | None = None
        self.kids: list[Slot] = []

    def add(self, nodes: list[Node]) -> None:
        """Take in the nodes of one more page."""
        _deep(self._add(nodes))

    def _add(self, nodes: list[Node]) -> Iterator:
        texts = [text_of(n) for n in nodes]
        own = {_hash(t) for t in texts if t}
        self.constant = own if self.constant is None else self.constant & own
        self.pages += 1
        self.main = self.main or nodes[0].main
        self.furniture = self.furniture or nodes[0].furniture
        self.chars += sum(map(len, texts))
        self.links += sum(len(text_of(n, True)) for n in nodes)
        for node in nodes:
            at = 0
            for (label, members), kid in align(runs(node), self.kids):
                if kid is None:
                    kid = Slot(label)
                    self.kids.insert(at, kid)
                at = self.kids.index(kid) + 1
                yield kid._add(members)

    def plain(self) -> list:
        """All slots in order, each with its number of kids."""
        out, stack = [], [self]
        while stack:
            s = stack.pop()
            out.append([s.label, s.pages, sorted(s.constant or ()) if s.pages >= CONSTANT_PAGES else [], s.chars, s.links, int(s.main), int(s.furniture), len(s.kids)])
            stack += s.kids[::-1]
        return out

    @staticmethod
    def of(plain: list) -> Slot:
        top, waiting = None, []  # slots that still wait for kids
        for label, pages, constant, chars, links, main, furniture, kids in plain:
            slot = Slot(label)
            slot.pages, slot.constant, slot.chars, slot.links, slot.main, slot.furniture = pages, set(constant), chars, links, bool(main), bool(furniture)
            top = top or slot
            if waiting:
                waiting[-1][0].kids.append(slot)
                waiting[-1][1] -= 1
                if not waiting[-1][1]:
                    waiting.pop()
            if kids:
                waiting.append([slot, kids])
        return top


def _weight(node: Node, slot: Slot, depth: int = 0) -> int:
    """Size of the largest match of two trees whose roots have one label (simple tree matching)."""
    if not slot.kids or depth > 12:
        return 1
    ours = runs(node)
    if not ours:
        return 1
    return 1 + sum(w for *_, w in _matching(ours, slot.kids, depth + 1))


def _matching(ours: list, slots: list[Slot], depth: int = 0) -> list[tuple[int, int, int]]:
    """Largest order-keeping match of two sequences of children, as (ours, slot, weight)."""
    n, m = len(ours), len(slots)
    if not n or not m:
        return []
    weights = {(i, j): _weight(members[0], s, depth) for i, (label, members) in enumerate(ours) for j, s in enumerate(slots) if s.label == label}
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        row, above = best[i], best[i - 1]
        for j in range(1, m + 1):
            w = weights.get((i - 1, j - 1), 0)
            row[j] = max(above[j], row[j - 1], above[j - 1] + w if w else 0)
    out, i, j = [], n, m
    while i and j:
        w = weights.get((i - 1, j - 1), 0)
        if w and best[i][j] == best[i - 1][j - 1] + w:
            out.append((i - 1, j - 1, w))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align(ours: list, slots: list[Slot]) -> list[tuple[tuple, Slot | None]]:
    """Each run of children with the slot it matches."""
    # Most pages repeat the wrapper's sequence; the match is then the whole of it.
    if [o[0] for o in ours] == [s.label for s in slots]:
        return list(zip(ours, list(slots)))
    pairs = {i: slots[j] for i, j, _ in _matching(ours, slots)}
    return [(run, pairs.get(i)) for i, run in enumerate(ours)]


def induce(pages: list[str]) -> str:
    """The wrapper of a host as JSON, from some of its pages."""
    top = Slot("html.")
    for html in pages:
        top.add([parse(html)])
    return json.dumps(top.plain(), separators=(",", ":"))


def _region(slot: Slot) -> Slot:
    """The slot of the main part: the marked one with most text, else the deepest that holds most unlinked text."""
    marked: list[Slot] = []

    stack = [slot]
    while stack:
        s = stack.pop()
        if not s.furniture:
            if s.main:
                marked.append(s)
            stack += s.kids[::-1]
    if marked:
        return max(marked, key=lambda s: s.chars - s.links)
    while True:
        free = [k for k in slot.kids if not k.furniture]
        best = max(free, key=lambda s: s.chars - s.links, default=None)
        if best is None or best.label.startswith(("p.", "h1.", "li.")) or best.chars - best.links < 0.7 * (slot.chars - slot.links):
            return slot
        slot = best


def extract(html: str, wrapper: Slot) -> str:
    """The main text of a page: blocks in order, one to a line."""
    page = parse(html)
    region = _region(wrapper)
    template: set[int] = set()  # nodes that hold the template's text
    found: list[Node] = []

    def walk(nodes: list[Node], slot: Slot, inside: bool) -> Iterator:
        inside = inside or slot is region
        if slot is region:
            found.extend(nodes)
        for node in nodes:
            if inside and not region.main and slot is not region and slot.constant and not slot.kids and _hash(text_of(node)) in slot.constant:
                template.add(id(node))
            for (_, members), kid in align(runs(node), slot.kids):
                if kid is not None:
                    yield walk(members, kid, inside)

    _deep(walk([page], wrapper, False))
    if not found:
        own = Slot("html.")
        own.add([page])
        if own.chars and wrapper.label:
            own.label = ""
            return _with(page, own)
        return ""
    blocks = _blocks(found, template)
    # A page that repeats another's article has nothing but constant nodes: then they are its content.
    return "\n".join(blocks if blocks else _blocks(found, set()))


def _with(page: Node, own: Slot) -> str:
    """Main text of a page that its host's wrapper doesn't fit: by the page's own tree."""
    region = _region(own)
    found: list[Node] = []

    def walk(nodes: list[Node], slot: Slot) -> Iterator:
        if slot is region:
            found.extend(nodes)
            return
        for node in nodes:
            for (_, members), kid in align(runs(node), slot.kids):
                if kid is not None:
                    yield walk(members, kid)

    _deep(walk([page], own))
    return "\n".join(_blocks(found, set()))


def _blocks(nodes: list[Node], template: set[int]) -> list[str]:
    out, current = [], []

    def flush() -> None:
        text = " ".join(unescape("".join(current)).split())
        if text:
            out.append(text)
        current.clear()

    for node in nodes:
        stack = [(iter(node.kids), False)]
        while stack:
            kids, block = stack[-1]
            for kid in kids:
                if isinstance(kid, str):
                    current.append(kid)
                elif kid.tag == "br":
                    current.append(" ")
                elif kid.furniture or id(kid) in template:
                    if kid.tag in BLOCK:
                        flush()
                else:
                    if kid.tag in BLOCK:
                        flush()
                    stack.append((iter(kid.kids), kid.tag in BLOCK))
                    break
            else:
                stack.pop()
                if block:
                    flush()
        flush()
    return out


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", sample: int = SAMPLE) -> DataFrame:
    """The main text of every page.

    Returns ``key``, ``url`` and text ('' if there is none).  A wrapper is induced
    per host from its ``sample`` distinct pages of the smallest hash; a host's
    sample is all that meets in one task.  A null url belongs to the host '', a
    null html is empty; a host of one page has no template, then marked parts and
    furniture decide.  Repeated rows repeat.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(key), F.col(url), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"), host.alias("host"))
    # Equal pages share a hash and count once; ranks are cut in each task before the shuffle.
    hashed = rows.select("host", "html", F.xxhash64("html").alias("h"))
    first = F.row_number().over(Window.partitionBy("host").orderBy("h"))
    places = hashed.select("host", "h").distinct().withColumn("rank", first).where(F.col("rank") <= sample).drop("rank")
    chosen = sieved(hashed, "h", places.select("h")).join(places, ["host", "h"]).groupBy("host", "h").agg(F.min("html").alias("html"))

    def induced(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [induce(group.sort_values("h")["html"].tolist())]})

    wrappers = chosen.groupBy("host").applyInPandas(induced, "host string, wrapper string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Slot] = {}
        for batch in steps(batches, "html"):
            texts = []
            for page, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist()):
                if wrapper not in known:
                    if len(known) > 500:
                        known.clear()
                    known[wrapper] = Slot.of(json.loads(wrapper))
                texts.append(extract(page, known[wrapper]) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[key, url, "text"])

    types = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    return rows.join(wrappers, "host").select(key, url, "html", "wrapper").mapInArrow(run, f"`{key}` {types[key]}, `{url}` {types[url]}, text string")
