"""Operator 10: main text of web pages by minimum cut.

A page is cut into blocks of text in page order. A logistic classifier over each block's ancestors, names,
links, length and punctuation (`html_model`, fitted there) gives the log odds of content: the terminal
capacities of a graph with one node for each block. Blocks that follow each other are tied the stronger the
nearer they are in the tree of elements, and so are blocks under one parent; these edges are fitted on the
same scale. The minimum cut of that graph separates content from boilerplate. Pages are independent, so Spark
maps over them in Arrow batches.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text of the page: code, head, raw text and what forms hold.
OPAQUE = frozenset("script style template iframe head title textarea select datalist".split())
#: Elements that end a block where they start and end.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that speak for what is not the article; for lists that often hold articles of their own; for a
#: state of what is inside; and for the article. What they count for is fitted, not set here.
SIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead toolbar ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies respond reader search widget pager pagination copyright legal disclaimer skip tags tagcloud complementary contentinfo dialog".split()
)
LIST_WORDS = frozenset("related recommended recommendations comment comments disqus reply replies respond".split())
STATE_WORDS = frozenset("has with without no open closed enabled disabled".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_WORDS = frozenset("article content main post entry story body text".split())

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
STOPS = (".", "!", "?", "…", ":", ";", "\"", "”", "»", "。")

#: What a block tells the classifier. whole, part, inner: an ancestor with a token of side words only, with one first or last, or
#: with one further in; the same for words of lists.
FEATURES = (
    "bias", "words", "few_words", "many_words", "links", "stop", "paragraph", "heading", "item", "cell", "nav", "footer", "aside", "form", "site_header", "inner_header",
    "main", "named", "whole", "part", "inner", "list_whole", "list_part", "list_inner", "sign", "first", "last", "hidden",
)
WHOLE, PART, INNER = 0, 1, 2


class Element(NamedTuple):
    tag: str
    number: int
    form: int | None  # WHOLE, PART or INNER where a name has side words
    listed: bool  # of a list
    main: bool  # an article or main, or named like one
    hidden: bool


class Block(NamedTuple):
    text: str
    features: np.ndarray
    parent: int
    steps: int  # up and down the tree from the block before


@lru_cache(maxsize=4_096)
def _named(tag: str, attrs: str) -> tuple[int | None, bool, bool, bool]:
    """(form of side words, of a list, main, hidden) of an element.

    Side words don't count in a token with a word of state, on html, body and main, where they speak of the page,
    and on an article that has a name of main words only.
    """
    form, listed, hidden, named, plain = None, False, False, False, False
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
        elif name in ("class", "id", "role"):
            for part in value.split():
                words = [w.lower() for w in SPLIT.split(part) if w]
                side = [w in SIDE_WORDS for w in words]
                if any(side):
                    if not STATE_WORDS.intersection(words):
                        new = WHOLE if all(side) else PART if side[0] or side[-1] else INNER
                        if form is None or new <= form:
                            listed = bool(LIST_WORDS.intersection(words)) or (listed and new == form)
                            form = new
                elif MAIN_WORDS.intersection(words):
                    named = True
                    plain = plain or MAIN_WORDS.issuperset(words)
    if tag in ("html", "body", "main") or tag == "article" and plain:
        form, listed = None, False
    return form, listed, form is None and (named or tag in MAIN_TAGS), hidden


def _apart(listed: bool, share: float, inside: int, around: bool, mains: int) -> float:
    """How far an element with side words, with this share of the page's text and `inside` of its articles and mains, is a side.

    What holds the article, or nearly all text, is a wrapper around the page and not its side; beside an article
    nothing is.
    """
    if not listed and inside:
        return 0.0
    if mains > inside and (listed or not around):
        return 1.0
    return min(1.0, (4.0 if listed else 1.0) * (1.0 - share))


class Sides:
    """The elements with side words, each with the one around it; what a block needs of all around it is kept along the way."""

    def __init__(self):
        self.above: list[int] = [-1]  # entry 0 is the page
        self.element: list[Element | None] = [None]
        self.around: list[bool] = [False]  # inside an article or main
        self.held = [0]  # characters in it, and how many articles and mains
        self.inside = [0]

    def open(self, e: Element, above: int, around: bool) -> int:
        self.above.append(above)
        self.element.append(e)
        self.around.append(around)
        self.held.append(0)
        self.inside.append(0)
        return len(self.above) - 1

    def shares(self) -> list[dict[int, float]]:
        """{place among the features: how far a side} of each, the most of it and all around it."""
        for k in range(len(self.above) - 1, 0, -1):  # what is inside is opened later
            self.held[self.above[k]] += self.held[k]
            self.inside[self.above[k]] += self.inside[k]
        out: list[dict[int, float]] = [{}]
        for k in range(1, len(self.above)):
            e, best = self.element[k], out[self.above[k]]
            apart = _apart(e.listed, self.held[k] / max(1, self.held[0]), self.inside[k], self.around[k], self.inside[0])
            place = FEATURES.index("whole") + 3 * e.listed + e.form
            out.append(best if best.get(place, 0.0) >= apart else best | {place: apart})
        return out


def blocks(page: str) -> list[Block]:
    """The blocks of a page in page order. Time grows with the page's length, however deep its elements are."""
    texts: list[str] = []
    rows: list[list[float]] = []
    tied: list[tuple[int, int]] = []
    stack: list[Element] = []
    within: list[int] = [0]  # the innermost entry of `sides` on each level of the stack
    opened = dict.fromkeys(BLOCKS, 0)  # how many elements of each tag are open
    sides, under = Sides(), []
    parts: list[str] = []
    never_closed: set[str] = set()
    linked = link = number = depth = low = 0
    mains = named = hides = 0  # open elements that are an article or main, are named like one, or are hidden

    def end() -> None:
        nonlocal linked, depth, low
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                near = {e.tag for e in stack[-3:]}
                main, nav, header = mains > 0, opened["nav"] + opened["menu"] > 0, opened["header"] > 0
                words = text.count(" ") + 1
                form = opened["form"] + opened["fieldset"] + opened["dialog"] + opened["search"] > 0
                rows.append([
                    1.0, np.log1p(words), words < 4, words >= 20, linked / len(text), text.endswith(STOPS), not near.isdisjoint(("p", "pre", "blockquote")), not near.isdisjoint(("h1", "h2", "h3", "h4", "h5", "h6")),
                    not near.isdisjoint(("li", "dt", "dd")), not near.isdisjoint(("td", "th")), nav, opened["footer"] > 0, opened["aside"] > 0, form,
                    header and not main, header and main, main, named > 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "©" in text and words < 40, not texts, False, hides > 0,
                ])
                texts.append(text)
                tied.append((stack[-2].number if len(stack) > 1 else 0, depth + len(stack) - 2 * min(low, len(stack))))
                under.append(within[-1])
                depth = low = len(stack)
                if not (form or nav or opened["footer"] or opened["aside"]):
                    sides.held[within[-1]] += len(text)
            parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal mains, named, hides
        e = stack.pop()
        within.pop()
        opened[e.tag] -= 1
        mains -= e.main and e.tag in MAIN_TAGS
        named -= e.main
        hides -= e.hidden

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            text = html.unescape(page[at:stop])
            parts.append(text)
            if link:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        closing = m[1] == "/"
        if tag in OPAQUE:
            if closing or m[3].endswith("/"):
                continue
            if tag in ("title", "head"):
                end()
            close = None
            if tag not in never_closed:
                close = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at) if tag != "head" else re.compile(r"</head\b[^>]*>|<body\b", re.I).search(page, at)
            if close:
                at = close.start() if close[0].lower().startswith("<body") else close.end()
            else:
                never_closed.add(tag)
                if tag in ("script", "style", "textarea", "title"):
                    at = size
            parts.append(" ")
        elif tag == "a":
            link = 0 if closing else 1
        elif tag in BLOCKS:
            end()
            if closing:
                while opened[tag]:
                    last = stack[-1].tag
                    pop()
                    if last == tag:
                        break
            elif tag not in VOID:
                if stack and (stack[-1].tag == "p" or stack[-1].tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th")):
                    pop()
                low = min(low, len(stack))
                form, listed, main, hidden = _named(tag, m[3].strip())
                number += 1
                if tag in MAIN_TAGS and main:
                    sides.inside[within[-1]] += 1
                e = Element(tag, number, form, listed, main, hidden)
                within.append(within[-1] if form is None else sides.open(e, within[-1], mains > 0))
                stack.append(e)
                opened[tag] += 1
                mains += main and tag in MAIN_TAGS
                named += main
                hides += hidden
            low = min(low, len(stack))
        elif tag == "br" or tag in VOID:
            parts.append(" ")
    end()
    out = np.array(rows, float).reshape(-1, len(FEATURES))
    shares = sides.shares()
    for i, k in enumerate(under):
        for place, share in shares[k].items():
            out[i, place] = share
    if len(out):
        out[-1, FEATURES.index("last")] = 1.0
    return [Block(t, f, *x) for t, f, x in zip(texts, out, tied, strict=True)]


def minimum_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the content side. cost > 0 speaks for boilerplate, by so much.

    A node whose cost outweighs all its edges is decided at once and its edges move into its neighbours'
    costs; that is exact and mostly leaves nothing. What is left goes to augmenting paths.
    """
    n = len(cost)
    cost = list(cost)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    side: list[bool | None] = [None] * n
    queue = list(range(n))
    while queue:
        a = queue.pop()
        if side[a] is not None or abs(cost[a]) < sum(near[a].values()) or (cost[a] == 0 and near[a]):
            continue
        side[a] = cost[a] <= 0
        for b, w in near[a].items():
            cost[b] += -w if side[a] else w
            del near[b][a]
            queue.append(b)
        near[a] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        source, sink = n, n + 1
        flow: dict[int, dict[int, float]] = {i: dict(near[i]) for i in left}
        flow[source] = {i: -cost[i] for i in left if cost[i] < 0}
        flow[sink] = {}
        for i in left:
            if cost[i] > 0:
                flow[i][sink] = cost[i]
        while True:
            back = {source: source}
            todo = [source]
            for a in todo:  # breadth first
                for b, w in flow[a].items():
                    if w > 1e-9 and b not in back:
                        back[b] = a
                        todo.append(b)
                if sink in back:
                    break
            if sink not in back:
                break
            path, b = [], sink
            while b != source:
                path.append((back[b], b))
                b = back[b]
            push = min(flow[a][b] for a, b in path)
            for a, b in path:
                flow[a][b] -= push
                flow[b][a] = flow[b].get(a, 0.0) + push
        for i in left:
            side[i] = i in back
    return [bool(s) for s in side]


def smoothness(found: list[Block], near: float, parent: float, decay: float) -> list[tuple[int, int, float]]:
    """Edges between blocks that follow each other, `near` between siblings and less by `decay` for each further step
    through the tree, and of `parent` between a block and the last one before it under its parent."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, near * decay ** max(0, b.steps - 2)))
        if b.parent in last and last[b.parent] != i - 1:
            out.append((last[b.parent], i, parent))
        last[b.parent] = i
    return out


def costs(found: list[Block], weights: np.ndarray) -> list[float]:
    """Log odds of each block against content."""
    return (-(np.array([b.features for b in found]) @ weights)).tolist() if found else []


def labelled(found: list[Block], model) -> list[bool]:
    """Which blocks are content."""
    return minimum_cut(costs(found, model.weights), smoothness(found, *model.edges))


def main_text(page: str, model=None) -> str:
    from framegrain.llm.html_model import fitted

    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, labelled(found, model or fitted()), strict=True) if keep)


def extract(df: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """One row for each input row: page_id, url, text, n_chars.

    Null, empty and text-free pages give the empty text. Repeated rows are extracted alike; an empty input
    gives an empty result; other columns are ignored. Markup that never closes ends with the page. Hidden elements are
    judged like others: being hidden is one of the things that the classifier looks at.
    """
    from framegrain.llm.html_model import fitted

    model = df.sparkSession.sparkContext.broadcast(fitted())  # some thirty numbers

    def task(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(p, model.value) if p else "" for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(task, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op10_html_extraction(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
