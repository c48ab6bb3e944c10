"""Main text of web pages by minimum-cut labelling of blocks.

A page is read into blocks (text between block-level tags). Two costs per block, from a classifier,
become the capacities from the source (content) and to the sink (boilerplate). Neighbours in page order and
blocks close in the element tree are tied by smoothness edges. The minimum cut, found by maximum
flow, labels all blocks of a page at once; the text of the content side is the main text.

The classifier is trained here: log-likelihood ratios of a block's features (ancestor elements, words
of class and id, length, link share, punctuation, place of heading) between two kinds of silver blocks,
counted over about ``TRAIN_PAGES`` pages: blocks of an article or main element outside boilerplate elements, and blocks
of boilerplate elements (``nav``, ``footer``, ``form`` and the like, or words of class and id that say so).
All costs stand on one scale with the edges, so the flow decides wherever the classifier is unsure or
alone: what its features say together (at most ``MOST``), standing inside or outside of the page's article
(``ARTICLE``), and standing in an element that is never content (``NEVER_COST``). Names of class and id that mark
boilerplate consist of listed words, alone or beside words that say nothing (``related-work`` marks nothing),
and alone don't
make boilerplate of a wrapper: neither of an element with most of the page's text, nor of one around
its main element or an article at least half as long as the longest article and as the unmarked text
outside of articles, nor of a page's own articles.

Scale: a map over the training pages (count) and one over all pages (label), each page by itself; only the table of feature
counts is shuffled, a few hundred rows. Blocks whose cost outweighs all their edges are fixed before
the flow is computed, so the graph that remains is small even for very long pages.

Defined results: null html is empty; broken markup is read to its end (an unclosed comment, script or
tag ends the text there); no content block gives an empty text; equal rows are read each for itself; pages
without any silver block anywhere use the block features' neutral cost; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches

# Element names of HTML by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark math mfrac mi mn "
                   "mo mrow msqrt msub msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg object select title xmp noembed noframes".split())
NEVER = frozenset("nav footer aside form button menu dialog fieldset head".split())
ARTICLES = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                     "form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PLAIN = frozenset(["", *"html body div section article main center table tbody tr".split()])  # say nothing of the text
#: Words of class, id and role attributes that mark boilerplate.
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter "
    "notice notices pagination pager popup promo promotion related replies reply respond search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription toolbar topbar widget contentinfo complementary".split())
#: Words that may stand beside those in one name; any other makes the name say something else (``related-work``).
BESIDE_WORDS = frozenset(
    "area bar block body bottom box btn button buttons card cell col column container content desktop element fixed form global "
    "group head header holder icon icons inline inner item items large layer left line link links list main mobile module "
    "outer page panel part post posts primary right row secondary section site small slot static sticky title top unit "
    "view wrap wrapper zone".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())

#: A tag; only a quote after "=" opens a string, any other is a character.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"""
                 r"""((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))*+)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""",
                       re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")

#: Smoothness: of neighbours in page order (halved for each step in the element tree beyond two), and of
#: neighbouring blocks under the same parent element.
ADJACENT, SIBLING = 3.0, 1.0
#: Steps in the element tree beyond which neighbours are not tied.
FAR = 24
SMOOTH = 1.0
#: Most that one feature says, and all features of the classifier together; the share of their sum that counts, since
#: features of one block say much the same.
LIMIT, MOST, SHARE = 3.0, 6.0, 0.35
#: Costs on the scale of the classifier's: on a page with an article or main element, of standing inside or
#: outside of it; of standing in an element that is never content.
ARTICLE, NEVER_COST = 10.0, 20.0


class Element:
    """An open or closed element; its place among the elements that aren't inline."""

    __slots__ = ("name", "parent", "up", "depth", "marked", "in_article", "size", "wrapper", "bad", "lost")

    def __init__(self, name: str, parent: "Element | None", marked: bool):
        self.name, self.parent, self.marked = name, parent, marked
        self.up = None if parent is None else parent if parent.name not in INLINE else parent.up
        self.depth = 0 if self.up is None else self.up.depth + 1
        self.in_article = parent is not None and (parent.in_article or parent.name == "article")  # of another article
        self.size, self.wrapper, self.bad, self.lost = 0, False, False, False


class Block:
    __slots__ = ("parts", "linked", "top", "place", "never", "article", "heading", "words")

    def __init__(self, top: Element, never: bool, article: bool, heading: bool, words: frozenset):
        self.parts: list[str] = []
        self.linked = 0
        self.top, self.place = top, top if top.name not in INLINE else top.up
        self.never, self.article, self.heading, self.words = never, article, heading, words

    @property
    def text(self) -> str:
        return SPACE.sub(" ", unescape("".join(self.parts))).strip()


def _marking(name: str) -> bool:
    """Whether a class, id or role name says boilerplate: a listed word, alone or beside words that say nothing."""
    words = set(WORD.findall(CAMEL.sub(" ", name).lower()))
    return bool(words & NEVER_WORDS) and words <= NEVER_WORDS | BESIDE_WORDS


def _marks(attributes: str) -> tuple[frozenset, bool, bool]:
    """Words of class, id and role, whether some name marks boilerplate, and whether the element is hidden."""
    words, marked, hidden = set(), False, False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            words.update(WORD.findall(CAMEL.sub(" ", value).lower()))
            marked = marked or any(map(_marking, value.split()))
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            hidden = True
    return frozenset(words), marked, hidden


def read_blocks(html: str | None) -> list[tuple[Block, str]]:
    """The blocks of a page with text, in page order."""
    html = html or ""
    root = Element("", None, False)
    elements = [root]
    # Open elements: (element, never content, in an article, in a heading, words on the path); how many have each name.
    stack: list[tuple[Element, bool, bool, bool, frozenset]] = [(root, False, False, False, frozenset())]
    opened: dict[str, int] = {}
    blocks: list[Block] = []
    now: Block | None = None
    links = 0
    at = 0

    def add(text: str) -> None:
        nonlocal now
        if now is None:
            if not text.strip():
                return
            now = Block(*stack[-1])
            blocks.append(now)
        now.parts.append(text)
        if links:
            now.linked += len(text)

    def close(to: int) -> None:
        nonlocal now, links
        for e, *_ in stack[to:]:
            links -= e.name == "a"
            opened[e.name] -= 1
            if e.name not in INLINE:
                now = None
        del stack[to:]

    def last(name: str) -> int:
        """Depth of the innermost open element of a name, 0 if there is none."""
        if not opened.get(name):
            return 0
        return next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0].name == name)

    while True:
        m = TAG.search(html, at)
        add(html[at:m.start()] if m else html[at:])
        if m is None:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in RAW:
                continue
            depth = last(name)
            if depth:
                close(depth)
            elif name not in INLINE:
                now = None
            continue
        if name == "br":
            add(" ") if now is not None else None
            continue
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            if name not in INLINE and name in ("textarea", "iframe", "title"):
                now = None
            continue
        if name in VOID:
            if name not in INLINE:
                now = None
            continue
        if name in CLOSES_P:
            depth = last("p")
            if depth and not any(e.name in ("table", "td", "li", "div", "section", "article") for e, *_ in stack[depth + 1:]):
                close(depth)
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            alike = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            for i in range(len(stack) - 1, 0, -1) if any(opened.get(x) for x in alike) else ():
                if stack[i][0].name in alike:
                    close(i)
                    break
                if stack[i][0].name in ("ul", "ol", "dl", "table", "tr" if name in ("td", "th") else "table"):
                    break
        if name not in INLINE:
            now = None
        words, marked, hidden = _marks(m[3]) if m[3].strip() else (frozenset(), False, False)
        top, never, in_article, heading, said = stack[-1]
        in_article = in_article or name in ARTICLES or "main" in words
        never = never or hidden or name in NEVER or (name == "header" and not in_article)
        more = words & CONTENT_WORDS if name in PLAIN or name in INLINE else words & CONTENT_WORDS | {f"<{name}>"}
        element = Element(name, top, marked)
        elements.append(element)
        opened[name] = opened.get(name, 0) + 1
        stack.append((element, never, in_article, heading or name in HEADINGS, said if more <= said else said | more))
        links += name == "a"
        if m[3].rstrip().endswith("/") and name not in INLINE:
            close(len(stack) - 1)
    found = [(b, t) for b in blocks if (t := b.text)]
    _judge_marked(found, elements)
    return found


def _judge_marked(blocks: list[tuple[Block, str]], elements: list[Element]) -> None:
    """Blocks in elements whose names mark boilerplate are never content, unless all those elements are wrappers.

    Sums go up and marks go down the tree in page order, so the work is linear in the elements.
    """
    if not any(e.marked for e in elements):
        return
    total = 0
    for b, t in blocks:
        if not b.never:
            b.top.size += len(t)
            total += len(t)
    for e in reversed(elements[1:]):
        e.parent.size += e.size
    for e in elements[1:]:
        e.wrapper = e.marked and 2 * e.size > total
        e.lost = e.parent.lost or (e.marked and not e.wrapper)
    # An article in an article is a comment or the like.
    own = [e for e in elements if e.name == "article" and not e.in_article]
    rest = sum(len(t) for b, t in blocks if not b.never and not b.top.lost and not (b.top.in_article or b.top.name == "article"))
    longest = max([rest, *(a.size for a in own)])
    for a in own:
        a.wrapper = True
    for a in elements:
        if a.size and (a.name == "main" or (a.name == "article" and not a.in_article and 2 * a.size >= longest)):
            while a is not None and not a.bad:  # ``bad``: what is around has been cleared
                a.wrapper = a.bad = True
                a = a.parent
    elements[0].bad = False
    for e in elements[1:]:
        e.bad = e.parent.bad or (e.marked and not e.wrapper)
    for b, _ in blocks:
        b.never = b.never or b.top.bad


def features(block: Block, text: str) -> list[str]:
    """What the classifier sees of a block."""
    n = len(text)
    share = block.linked / max(1, sum(map(len, block.parts)))
    return [f"len{min(6, n.bit_length() // 2)}", f"link{round(share * 4)}", f"stop{int(text[-1] in '.!?:;')}",
            f"comma{min(3, text.count(','))}", f"head{int(block.heading)}", *sorted(block.words)]


def silver(block: Block) -> int:
    """1 for content, 0 for boilerplate, -1 if unknown."""
    return 0 if block.never else 1 if block.article else -1


def weights_of(counts: dict[tuple[str, int], int], blocks: tuple[int, int]) -> dict[str, float]:
    """Log-likelihood ratio of each feature, within +-LIMIT."""
    out = {}
    for f in {f for f, _ in counts}:
        good = (counts.get((f, 1), 0) + SMOOTH) / (blocks[1] + 2 * SMOOTH)
        bad = (counts.get((f, 0), 0) + SMOOTH) / (blocks[0] + 2 * SMOOTH)
        out[f] = float(np.clip(np.log(good / bad), -LIMIT, LIMIT))
    return out


def min_cut(cost: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Content flags of least energy: max(cost, 0) for each content block labelled boilerplate, max(-cost, 0)
    for the reverse, and each edge whose ends differ."""
    n = len(cost)
    cost = cost.astype(float).copy()
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    label = np.full(n, -1)
    # A block whose own cost outweighs its edges has its label in every minimum cut; its edges become costs.
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] < 0 and abs(cost[i]) >= sum(near[i].values()) and (cost[i] or not near[i]):
            label[i] = int(cost[i] > 0)
            for j, w in near[i].items():
                cost[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    left = np.flatnonzero(label < 0)
    if not len(left):
        return label > 0
    # Maximum flow by shortest augmenting paths on what remains.
    s, t = n, n + 1
    cap: dict[int, dict[int, float]] = {int(i): dict(near[i]) for i in left} | {s: {}, t: {}}
    for i in left.tolist():
        if cost[i] > 0:
            cap[s][i], cap[i][s] = float(cost[i]), 0.0
        elif cost[i] < 0:
            cap[i][t], cap[t][i] = float(-cost[i]), 0.0
    while True:
        before = {s: s}
        queue = deque([s])
        while queue and t not in before:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > 1e-12 and j not in before:
                    before[j] = i
                    queue.append(j)
        if t not in before:
            break
        path = [t]
        while path[-1] != s:
            path.append(before[path[-1]])
        flow = min(cap[path[k + 1]][path[k]] for k in range(len(path) - 1))
        for k in range(len(path) - 1):
            cap[path[k + 1]][path[k]] -= flow
            cap[path[k]][path[k + 1]] += flow
    for i in left.tolist():
        label[i] = int(i in before)
    return label > 0


def _apart(a: Element, b: Element) -> int:
    """Steps between two places in the element tree, up to ``FAR``."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def costs_of(blocks: list[tuple[Block, str]], weights: dict[str, float]) -> np.ndarray:
    """What speaks for content (above 0) or boilerplate (below), block by block, all on one scale."""
    inside = ARTICLE if any(b.article and not b.never for b, _ in blocks) else 0.0
    said = SHARE * np.array([sum(weights.get(f, 0.0) for f in features(b, t)) for b, t in blocks])
    return (np.clip(said, -MOST, MOST) + np.array([inside if b.article else -inside for b, _ in blocks])
            - np.array([NEVER_COST if b.never else 0.0 for b, _ in blocks]))


def edges_of(blocks: list[tuple[Block, str]]) -> list[tuple[int, int, float]]:
    """Smoothness edges: page order, and siblings in the tree."""
    edges = []
    last: dict[int, int] = {}
    for i, (b, _) in enumerate(blocks):
        if i and not blocks[i - 1][0].never and not b.never:
            steps = _apart(blocks[i - 1][0].place, b.place)
            if steps < FAR:
                edges.append((i - 1, i, ADJACENT * 0.5 ** max(0, steps - 2)))
        parent = id(b.place.up)
        if parent in last:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    return edges


def label_page(blocks: list[tuple[Block, str]], weights: dict[str, float]) -> np.ndarray:
    return min_cut(costs_of(blocks, weights), edges_of(blocks))


def main_text(html: str | None, weights: dict[str, float]) -> str:
    blocks = read_blocks(html)
    if not blocks:
        return ""
    return "\n".join(t for (_, t), keep in zip(blocks, label_page(blocks, weights)) if keep)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, label, count) of the task's silver blocks; feature null counts the blocks."""
    seen: dict[tuple[str | None, int], int] = {}
    for b in batches:
        for html in b.column(0).to_pylist():
            for block, text in read_blocks(html):
                y = silver(block)
                if y >= 0:
                    for f in (None, *features(block, text)):
                        seen[f, y] = seen.get((f, y), 0) + 1
    yield pa.RecordBatch.from_arrays(
        [pa.array([f for f, _ in seen], pa.string()), pa.array([y for _, y in seen], pa.int64()),
         pa.array(list(seen.values()), pa.int64())], names=["feature", "label", "n"])


#: Pages that the classifier is trained on, about; with fewer pages all of them.
TRAIN_PAGES = 20_000


def train(pages: DataFrame, html_col: str = "html", about: int = TRAIN_PAGES) -> dict[str, float]:
    """Feature weights from pages drawn by the hash of their markup; elements and listed words bound their number."""
    given = pages.select(F.col(html_col).cast("string").alias("html"))
    n = given.count()
    if n > about:
        given = given.filter(F.pmod(F.xxhash64("html"), F.lit(1 << 24)) / (1 << 24) < about / n)
    rows = map_batches(given, _count,
                       "feature string, label long, n long").groupBy("feature", "label").agg(F.sum("n").alias("n"))
    counts = {(r["feature"], r["label"]): r["n"] for r in rows.collect()}
    blocks = (counts.get((None, 0), 0), counts.get((None, 1), 0))
    return weights_of({k: n for k, n in counts.items() if k[0] is not None}, blocks)


def extract(pages: DataFrame, *, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` and the main text of each."""
    spark = pages.sparkSession
    sent = spark.sparkContext.broadcast(train(pages, html_col))
    small_batches(spark)

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, sent.value) for h in html], dtype=object)

    return pages.withColumn(out, text(F.col(html_col).cast("string")))
