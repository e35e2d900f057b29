"""Main text of web pages by a tree-structured graphical model (operator 9).

Block elements of a page are nodes with two states, content and other. Potentials of the single nodes come from counted features,
potentials between parent and child from counted pairs of states; both are counted on labelled pages, those that mark their
article. Sum-product messages go up the tree and down again; blocks whose marginal favours content make the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import slices

# Element names by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template noscript iframe svg math object canvas select textarea button head title audio video datalist".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var".split())
_REGION = frozenset(("article", "main"))
_OUTSIDE = frozenset("nav footer aside form dialog menu".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXT = frozenset("p blockquote pre figcaption dd dt".split())
_LIST = frozenset("ul ol li dl table tbody thead tr td th".split())
#: Parts of class, id and role names of boxes that are not the article.
_OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side rail footer foot masthead header "
    "comment comments respond replies disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended "
    "widget toolbar pagination pager search form disclaimer complementary contentinfo".split()
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "outside", "region", "own", "linked")

    def __init__(self, tag: str, parent: int, outside: bool, region: bool):
        self.tag, self.parent, self.outside, self.region = tag, parent, outside, region
        self.own = self.linked = 0


def _is_outside(tag: str, attributes: str, in_region: bool) -> bool:
    if tag in _OUTSIDE or tag == "header" and not in_region:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or "display" in attributes:
        if _HIDDEN.search(attributes):
            return True
    return any(p.lower() in _OUTSIDE_NAMES for m in _NAMES.finditer(attributes) for p in _PART.findall(m.group(2)) if not (in_region and p.lower() in ("header", "side")))


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order (a parent before its children) and text blocks (node, text with one kind of blank).

    Forgiving as browsers are: a paragraph ends where a block starts, list items and cells end each other, an end tag closes what
    is open inside, one without a start is ignored. Comments, scripts, styles, heads and form controls are skipped. Linear in the page.
    """
    nodes, blocks = [Node("html", -1, False, False)], []
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements; inline ones share the node of their block
    depth: Counter = Counter({"html": 1})
    pieces: list[str] = []
    at, size, links = 0, len(page), 0

    def flush() -> None:
        if pieces:
            text = _SPACES.sub(" ", "".join(pieces)).strip()
            pieces.clear()
            if text:
                node = stack_node[0]
                blocks.append((node, text))
                nodes[node].own += len(text)

    stack_node = [0]

    def pop() -> None:
        tag, _ = stack.pop()
        depth[tag] -= 1
        stack_node[0] = stack[-1][1] if stack else 0

    def add(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links:
            nodes[stack_node[0]].linked += len(text.strip())

    while at < size:
        open_at = page.find("<", at)
        if open_at < 0:
            add(page[at:])
            break
        if open_at > at:
            add(page[at:open_at])
        if page.startswith("<!--", open_at):
            end = page.find("-->", open_at + 4)
            at = size if end < 0 else end + 3
            continue
        found = _TAG.match(page, open_at)
        if not found:
            if page[open_at + 1 : open_at + 2] in ("!", "?", "/"):
                end = page.find(">", open_at)
                at = size if end < 0 else end + 1
            else:
                add("<")
                at = open_at + 1
            continue
        end = found.end()
        while True:  # the end of the tag, past quoted values
            close = page.find(">", end)
            if close < 0:
                close = size
                break
            quote = min((q for q in (page.find('"', end, close), page.find("'", end, close)) if q >= 0), default=-1)
            if quote < 0 or page[quote - 1] not in "= \n\t":
                break
            shut = page.find(page[quote], quote + 1)
            if shut < 0:
                break
            end = shut + 1
        tag, attributes = found.group(1).lower(), page[found.end() : close]
        at = close + 1
        if page[open_at + 1] == "/":
            if depth[tag] > 0 and tag != "html":
                if tag not in _INLINE:
                    flush()
                while True:
                    name = stack[-1][0]
                    if name not in _INLINE:
                        flush()
                    if name == "a":
                        links -= 1
                    pop()
                    if name == tag:
                        break
            elif tag == "p":
                flush()
            continue
        if tag in _RAW:
            if not attributes.endswith("/"):
                stop = re.compile(rf"</{tag}(?=[\s/>])|</{tag}$", re.I).search(page, at) if tag not in ("head",) else re.compile(r"</head(?=[\s/>])|<body(?=[\s/>])", re.I).search(page, at)
                if stop is None:
                    at = size if tag != "head" else at
                elif page.startswith("<b", stop.start()) or page.startswith("<B", stop.start()):
                    at = stop.start()
                else:
                    close = page.find(">", stop.start())
                    at = size if close < 0 else close + 1
            pieces.append(" ") if tag not in ("script", "style", "template", "noscript") else None
            continue
        if tag in ("br", "wbr"):
            pieces.append(" " if tag == "br" else "")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag == "html":
            continue
        if tag in _INLINE:
            stack.append((tag, stack[-1][1]))
            depth[tag] += 1
            links += tag == "a"
            continue
        flush()
        shut = _CLOSES.get(tag, ())
        while depth["p"] and any(n == "p" for n, _ in stack[-8:]) or any(depth[s] for s in shut) and _near(stack, shut):
            name = stack[-1][0]
            if name == "a":
                links -= 1
            pop()
        parent = stack[-1][1]
        region = nodes[parent].region or tag in _REGION
        outside = _is_outside(tag, attributes, region)
        nodes.append(Node(tag, parent, outside, region))
        stack.append((tag, len(nodes) - 1))
        depth[tag] += 1
        stack_node[0] = len(nodes) - 1
    flush()
    return nodes, blocks


def _near(stack: list[tuple[str, int]], shut: tuple[str, ...]) -> bool:
    """An element that the new one ends is open, with no list or table begun inside it."""
    for name, _ in reversed(stack):
        if name in shut:
            return True
        if name in ("ul", "ol", "dl", "table", "html") or name in _REGION:
            return False
    return False


def features(node: Node) -> tuple[str, ...]:
    """What a node shows: its role, the size of its own text and its links. A box without text of its own shows nothing, so it goes with
    what is around and inside; inside an article a text's size says nothing either, as its headings, items and cells are short."""
    tag, plain = node.tag, not node.linked
    if node.outside:
        role = "outside"
    elif tag in _REGION:
        role = "region"
    elif tag in ("html", "body"):
        role = "root"
    elif not node.own:
        return ()
    elif tag in _HEADING:
        role = "heading"
    elif tag in _TEXT or plain and (tag in _LIST or tag == "caption"):
        role = "text"
    else:
        role = "list" if tag in _LIST else "box"
    links = -1 if not node.own else 2 if node.linked * 2 > node.own else 1 if node.linked else 0
    shown = (f"role:{role}", f"links:{links}")
    size = min(4, int(math.log10(node.own + 1) * 1.5)) if node.own else -1
    return shown if node.region else (*shown, f"size:{size}")


_VALUES = {"role": 7, "size": 6, "links": 4}


def _group(node: Node) -> str:
    return "outside" if node.outside else "region" if node.region else "plain"


@dataclass
class PageModel:
    """Log odds of each feature, of the root, and for each group of parents the log probabilities [parent state][child state]."""

    odds: dict[str, float]
    pairs: dict[str, list[list[float]]]


def labels(nodes: list[Node]) -> list[int] | None:
    """1 for blocks inside the marked article and outside of boxes that are none; None if the page marks no article."""
    if not any(n.tag in _REGION for n in nodes):
        return None
    out: list[int] = []
    shut: list[bool] = []
    for n in nodes:
        shut.append(n.outside or n.parent >= 0 and shut[n.parent])
        out.append(int(n.region and not shut[-1]))
    return out


def estimate(counts: dict[tuple[str, int], int]) -> PageModel:
    """Potentials from counts of (feature, state) and (pair group and parent state, child state).

    Before any page is seen, a hundred blocks in each state are believed to have flat features, and the boxes known by name to hold no content.
    """
    odds, pairs = {}, {}
    total = [sum(n for (f, s), n in counts.items() if f.startswith("role:") and s == state) for state in (0, 1)]
    names = [f"role:{r}" for r in ("outside", "region", "heading", "text", "list", "root", "box")] + [f"size:{i}" for i in range(-1, 5)] + [f"links:{i}" for i in range(-1, 3)]
    for f in names:
        prior = [100 / _VALUES[f.split(":")[0]]] * 2
        if f == "role:outside":
            prior = [100, 0.01]
        p = [(counts.get((f, s), 0) + prior[s]) / (total[s] + 200) for s in (0, 1)]
        odds[f] = math.log(p[1] / p[0])
    for group in ("outside", "region", "plain"):
        table = []
        for parent in (0, 1):
            prior = [100, 0.001] if group == "outside" else [90, 10] if not parent else [10, 90]
            n = [counts.get((f"pair:{group}:{parent}", child), 0) + prior[child] for child in (0, 1)]
            table.append([math.log(x / sum(n)) for x in n])
        pairs[group] = table
    return PageModel(odds, pairs)


def marginals(nodes: list[Node], model: PageModel) -> list[float]:
    """Probability of content of each node: one pass of messages from the leaves to the root, one back."""
    odds, n = model.odds, len(nodes)
    # a long page must not win by many features alone: the size classes count once each
    belief = [sum(odds[f] for f in features(v)) for v in nodes]  # log odds, grows by the children's messages
    message = [0.0] * n
    tables = [model.pairs[_group(v)] for v in nodes]

    def through(t: list[list[float]], d: float) -> float:
        """Message to the other end: log odds of its states when this end has log odds d."""
        d = max(-60.0, min(60.0, d))
        e = math.exp(d)
        return math.log((math.exp(t[1][0]) + math.exp(t[1][1]) * e) / (math.exp(t[0][0]) + math.exp(t[0][1]) * e))

    for i in range(n - 1, 0, -1):
        parent = nodes[i].parent
        message[i] = through(tables[parent], belief[i])
        belief[parent] += message[i]
    for i in range(1, n):
        parent = nodes[i].parent
        t = tables[parent]
        rest = max(-60.0, min(60.0, belief[parent] - message[i]))  # what the parent believes without this child
        e = math.exp(rest)
        belief[i] += math.log((math.exp(t[0][1]) + math.exp(t[1][1]) * e) / (math.exp(t[0][0]) + math.exp(t[1][0]) * e))
    return [1 / (1 + math.exp(-max(-60.0, min(60.0, b)))) for b in belief]


def fit_pages(pages: DataFrame, column: str = "html") -> PageModel:
    """Count features and pairs of states on every page that marks its article; a bounded number of counts reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches, "html"):
            for page in batch.column("html").to_pylist():
                if not page:
                    continue
                nodes, _ = parse(page)
                states = labels(nodes)
                if states is None:
                    continue
                for node, state in zip(nodes, states, strict=True):
                    seen.update((f, state) for f in features(node))
                    if node.parent >= 0:
                        seen[f"pair:{_group(nodes[node.parent])}:{states[node.parent]}", state] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([s for _, s in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["name", "state", "n"])

    rows = pages.select(F.col(column).cast("string").alias("html")).mapInArrow(count, "name string, state int, n long").groupBy("name", "state").agg(F.sum("n").alias("n"))
    return estimate({(r.name, r.state): r.n for r in rows.collect()})


def main_text(page: str, model: PageModel) -> str:
    nodes, blocks = parse(page)
    content = marginals(nodes, model)
    return "\n".join(text for node, text in blocks if content[node] > 0.5)


def extract_text(pages: DataFrame, model: PageModel, column: str = "html") -> DataFrame:
    """Add ``text``, the article's blocks in page order, joined by line feeds, to every row; null and empty pages: empty.

    White space in a block becomes one blank. All rows and columns stay; a column called ``text`` is replaced.
    """
    kept = pages.drop("text") if column != "text" else pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            texts = [main_text(p, model) if p else "" for p in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("text", T.StringType())]))
