"""Main text of web pages by site style trees.

Each page becomes a tree; pages of a host are merged into one style tree, whose nodes are paths of elements with
their presentation (tag, class, id). Spark counts, for each node of a host, the different pages (copies, of the same
blocks, are one page), the different presentations of its children and the different contents below it. A node's
importance is an entropy: of the presentations of an element (how differently its children are laid out), and of the
contents below it over the host's pages. A branch whose content hardly varies over a host is a template and goes.

What a page says of an element is a prior, by which its importance is multiplied before it is held against the
threshold: 2 within `article` and `main`, 1/3 for a word among its class, id or role that often names boilerplate, 1/6
for one that names nothing else (adverts, readers' comments), and for such a word on a link. So a differing branch
within an article stays if a word of content like `search` or `share` is its class, and a reader's comment, which
differs on every page, goes. No word counts on `article`, `main` or an element around one, nor, outside them, on an
element that holds half of the page's text; an article among readers' comments is one of them, unless it is the page's
first. Elements of some tags and hidden ones go whatever they hold; a form around the article is no such element.
Where the text of `article` and `main` is at least `main_share` of all that stays, what is outside them goes.

A host may have a third of all pages: nodes are counted by (host, node) with partial sums, no host is gathered, and of
the nodes that go only the topmost ones travel to the host's pages. Reading a page takes time linear in its length:
nodes are hashed from their parents' hashes, contents from the contents of their children.

Defined results: null or empty html, and pages without main text, give an empty text; broken html is read as far
as it goes: open elements end with the page, a tag or comment that the page ends in is dropped; an unreadable url is a
host of its own ('' for null); repeated rows are each returned; blocks without words are dropped. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import materialize

# Elements without an end tag; elements that never hold main text; elements that end a block;
# elements that an open p does not survive; words of class, id or role that often name boilerplate, and those that name
# nothing else; words before one of them that say that an element only has it.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = {"head", "title", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "textarea", "iframe", "svg", "object", "menu", "dialog"}
BLOCKS = {"address", "article", "blockquote", "body", "br", "caption", "dd", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "header", "hgroup", "details", "summary"} | NEVER
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WEAK = {"footer", "menu", "nav", "navigation", "notice", "related", "replies", "reply", "search", "share", "sharing", "social", "subscribe", "widget", "complementary", "contentinfo"}
STRONG = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "modal", "navbar", "newsletter", "pager", "pagination", "popup", "promo", "sidebar", "sponsor", "sponsored", "toolbar"}
HAVING = {"has", "have", "with", "without", "no", "is", "layout"}


def _names(values: Iterable[str], words: set[str]) -> bool:
    """Whether a class, id or role has one of the words, without a word like `has` before it."""
    for token in " ".join(values).lower().split():
        parts = [w for w in re.split(r"[^a-z]+", token) if w]
        if any(w in words and not (i and parts[0] in HAVING) for i, w in enumerate(parts)):
            return True
    return False


class _Element:
    """An element of a page: its node, what its tag and words say of it, and what it holds."""

    __slots__ = ("among", "around", "children", "content", "hard", "in_main", "key", "last", "main", "node", "parent", "shown", "size", "strong", "tag", "weak")

    def __init__(self, tag: str, parent: _Element | None, shown: str = "", hard: bool = False, strong: bool = False, weak: bool = False, first: bool = False) -> None:
        self.tag, self.parent, self.shown, self.hard, self.strong, self.weak = tag, parent, shown, hard, strong, weak
        self.node = tag in BLOCKS
        self.key = (xxhash.xxh64_intdigest(f"{parent.key:x} {shown}".encode("utf-8", "surrogatepass")) if self.node else parent.key) if parent else 0
        self.among = bool(parent and parent.among) or strong
        self.main = tag in ("article", "main") and (first or not self.among)
        self.in_main = self.main or bool(parent and parent.in_main)
        self.around, self.size, self.last = False, 0, None
        self.content, self.children = xxhash.xxh64(), xxhash.xxh64()
        if self.main:
            self.among = False
            while parent and not parent.around:
                parent.around, parent = True, parent.parent

    def removed(self) -> bool:
        """Whether the element's tag or a hiding attribute removes it."""
        return self.hard and not (self.around and self.tag == "form")

    def prior(self, half: float) -> float:
        """What the importance of the element is multiplied by, where `half` is half of the page's text; 0: whatever it holds, it goes."""
        if self.removed():
            return 0
        within = 2 if self.in_main else 1
        if self.main or self.around or not (self.strong or self.weak):
            return within
        if self.strong or self.tag == "a":
            return within / 6
        if not self.node:
            return within if self.in_main else within / 6
        return within / 3 if self.in_main or self.size < half else within


class _Reader(HTMLParser):
    """The elements of a page in the order of their begins, and its blocks: (innermost element, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Element("", None)
        self.elements, self.stack, self.blocks = [self.root], [self.root], []
        self.parts: list[str] = []
        self.found_main = False
        self.rows: dict[int, tuple[int, bool, xxhash.xxh64, xxhash.xxh64]] = {}

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.blocks.append((self.stack[-1], text))
            self.stack[-1].size += len(text)
            self.stack[-1].content.update(b"t" + text.encode("utf-8", "surrogatepass") + b"\0")

    def _pop(self, upto: int) -> None:
        while len(self.stack) > upto:
            last, parent = self.stack[-1], self.stack[-2]
            if last.node or last.hard or _dropped_inline(last):
                self._flush()
            self.stack.pop()
            parent.size += last.size
            if last.size:
                parent.content.update(b"e" + last.content.digest())
            if last.size and last.node:
                row = self.rows.setdefault(last.key, (_node_key(last.parent), last.weak, xxhash.xxh64(), xxhash.xxh64()))
                row[2].update(last.children.digest())
                row[3].update(last.content.digest())
                at = parent
                while not at.node and at.parent:
                    at = at.parent
                if at.last != last.shown:
                    at.last = last.shown
                    at.children.update(last.shown.encode("utf-8", "surrogatepass") + b"\0")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag in BLOCKS:
                self._flush()
            return
        if tag in ENDS_P:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == "p":
                    self._pop(i)
                    break
                if self.stack[i].tag in BLOCKS:
                    break
        elif tag in SAME:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in SAME[tag]:
                    self._pop(i)
                    break
                if self.stack[i].tag in {"ul", "ol", "dl", "table"}:
                    break
        known = {k: v or "" for k, v in attrs if k in ("class", "id", "role")}
        unseen = any(k == "hidden" or k == "style" and re.search(r"display\s*:\s*none", v or "") for k, v in attrs)
        hard = tag in NEVER or (tag == "header" and not self.stack[-1].in_main) or unseen
        named = [] if tag in ("html", "body") else list(known.values())
        shown = tag + "".join(f".{c}" for c in sorted(known.get("class", "").split())) + (f"#{known['id']}" if known.get("id") and not re.search(r"\d", known["id"]) else "")
        first = not self.found_main and tag in ("article", "main")
        new = _Element(tag, self.stack[-1], shown, hard, _names(named, STRONG), _names(named, WEAK), first)
        self.found_main |= new.main
        if new.node or hard or _dropped_inline(new):
            self._flush()
        self.elements.append(new)
        self.stack.append(new)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._pop(i)
                return
            if self.stack[i].tag in ("article", "body", "td") and tag not in ("article", "body", "html", "table", "tr", "main", "section", "div"):
                return

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def _dropped_inline(e: _Element) -> bool:
    """Whether an element within a line is a part of its own: one that its words alone can remove."""
    return not e.node and (e.strong or e.weak and (e.tag == "a" or not e.in_main))


def _node_key(e: _Element) -> int:
    while not e.node and e.parent:
        e = e.parent
    return e.key


def read(html: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(html or "")
    # What is left is text, or a tag, comment or script that the page ends in; those are no text.
    if reader.rawdata and reader.cdata_elem is None and not re.match(r"<[A-Za-z/!?]", reader.rawdata):
        reader.handle_data(unescape(reader.rawdata))
    reader._pop(1)
    reader._flush()
    return reader


def _signed(key: int) -> int:
    return key - (1 << 63)


SHAPE = "host string, page long, parent long, node long, weak boolean, child long, content long"


def style_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each page and node: hashes of the page's blocks, of the presentations of the node's children and of what is below it."""
    for pdf in batches:
        rows: set[tuple] = set()
        for host, html in zip(pdf["host"], pdf["html"], strict=True):
            reader = read(html)
            page = _signed(reader.root.content.intdigest())
            for key, (parent, weak, children, content) in reader.rows.items():
                rows.add((host, page, _signed(parent), _signed(key), weak, _signed(children.intdigest()), _signed(content.intdigest())))
        yield pd.DataFrame(list(rows), columns=["host", "page", "parent", "node", "weak", "child", "content"])


def importance(pages: DataFrame) -> DataFrame:
    """host, node, parent, weak (its words), pages (different ones), importance: entropies to the base of the number of pages, from 0 (the same everywhere) to 1."""
    nodes = materialize(pages.select("host", "html").mapInPandas(style_nodes, SHAPE).distinct(), "style-nodes")

    def entropy(by: str) -> DataFrame:
        counts = nodes.groupBy("host", "parent", "node", "weak", by).agg(F.count("*").alias("n"))
        return counts.groupBy("host", "parent", "node", "weak").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("weighted"))

    bits = F.when(F.col("pages") > 1, (F.log("pages") - F.col("weighted") / F.col("pages")) / F.log("pages")).otherwise(1.0)
    content = entropy("content").select("host", "node", "parent", "weak", "pages", bits.alias("content"))
    style = entropy("child").select("host", "node", bits.alias("style"))
    return content.join(style, ["host", "node"]).select("host", "node", "parent", "weak", "pages", F.greatest("content", "style").alias("importance"))


def topmost(low: DataFrame) -> DataFrame:
    """Nodes (host, node, parent) whose parent is not among them: what is below goes with it."""
    above = low.select("host", F.col("node").alias("parent"))
    return low.join(above, ["host", "parent"], "left_anti").select("host", "node")


def main_text(html: str | None, low: Sequence[tuple[float, set[int]]], threshold: float, main_share: float) -> str:
    """The text of a page without the branches whose importance times their prior is under the threshold.

    low: bounds of importance, each with the host's nodes that are under it; nodes whose parent is under it too may be left
    out, where the parent's removal follows.
    """
    reader, gone, removed = read(html), set(), set()
    for e in reader.elements:
        if id(e.parent) in removed or e.removed():
            removed.add(id(e))
    half = sum(len(t) for e, t in reader.blocks if id(e) not in removed) / 2
    for e in reader.elements:
        prior = e.prior(half)
        bad = id(e.parent) in gone or prior < threshold  # even an importance of 1 is too low
        if e.node and not bad:
            bad = any(bound * prior <= threshold + 1e-9 and _signed(e.key) in nodes for bound, nodes in low)
        if bad:
            gone.add(id(e))
    kept = [(e.in_main, text) for e, text in reader.blocks if id(e) not in gone]
    if sum(len(t) for m, t in kept if m) >= main_share * sum(len(t) for _, t in kept):
        kept = [x for x in kept if x[0]] or kept
    return " ".join(t for _, t in kept)


def extract(pages: DataFrame, least_pages: int = 8, threshold: float = 0.35, main_share: float = 0.2, broadcast_nodes: int = 1_000_000) -> DataFrame:
    """page_id, url, text, n_chars. The importance of a node counts if at least `least_pages` different pages of the host have it."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    sources = pages.select("page_id", "url", "html", host.alias("host"))
    bounds = [threshold / prior for prior in (2, 1, 2 / 3)]  # of the priors that an importance of up to 1 can decide
    judged = materialize(importance(sources).filter((F.col("pages") >= least_pages) & (F.col("importance") < bounds[-1])), "style-low")
    # The last bound is for words within article or main: there a parent without such a word may stay, so all count.
    under = [judged.filter(F.col("importance") < bound) for bound in bounds]
    parts = [topmost(under[0]), topmost(under[1]), under[2].filter("weak").select("host", "node")]
    every = [part.withColumn("bound", F.lit(k)) for k, part in enumerate(parts)]
    of = lambda k: F.collect_set(F.when(F.col("bound") == k, F.col("node")))
    low_nodes = materialize(reduce(DataFrame.unionByName, every).groupBy("host").agg(*[of(k).alias(f"low_{k}") for k in range(len(bounds))]), "style-trees")
    # Low nodes of a host are the tops of its templates; the join adds three arrays to each page. They are broadcast only
    # where they are few; beyond that pages are shuffled by host (and a large host is split by the skew join).
    few = low_nodes.agg(F.coalesce(F.sum(F.size("low_0") + F.size("low_1") + F.size("low_2") + 8), F.lit(0)).alias("n")).first()["n"] <= broadcast_nodes
    joined = sources.join(F.broadcast(low_nodes) if few else low_nodes, "host", "left")

    @F.pandas_udf("string")
    def texts(htmls: pd.Series, *lows: pd.Series) -> pd.Series:
        out = []
        for html, *nodes in zip(htmls, *lows, strict=True):
            out.append(main_text(html, [(bound, set() if n is None else set(n)) for bound, n in zip(bounds, nodes, strict=True)], threshold, main_share))
        return pd.Series(out, dtype=object)

    out = joined.select("page_id", "url", texts.asNondeterministic()("html", *[f"low_{k}" for k in range(len(bounds))]).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
