"""Main text of pages by a vote of every host on the path of its content container.

A page's blocks are scored by their text outside links, and the page votes for the
container that holds its article: the body may be left for the child that holds most
of the score past boxes with a class or id of their own, any other container only for a
child outside of which there is nothing but links, and an article element is never entered. Votes go to generalised paths, tags
with their classes without numbers, and are counted per host in Spark. Every page is
then extracted again with its host's winning path, or with its own where that path is
absent or would leave out part of the page's own container. Navigation, notices, adverts,
forms and reader comments are left out by tag and role wherever they stand. A class or id
alone marks only elements around the article: in it, the id of a section is often its
title, so that a second sign is asked for, see :func:`_judge`.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscope.session import write_table

#: Share of the score that one child of the body must hold to be entered past other named boxes.
MOST = 0.75

#: A quote begins a string only behind an equals sign; no way back into it keeps the search linear in a tag.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "noembed", "noframes", "xmp", "desc", "metadata"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "label", "nobr", "ruby", "rb", "rt", "rp",
    "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mspace",
    "svg", "g", "defs", "use", "path", "circle", "ellipse", "line", "polygon", "polyline", "rect", "text", "tspan",
    "symbol", "clippath", "mask", "lineargradient", "radialgradient", "stop", "filter", "animate",
}
_DROPPED = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "audio", "video", "canvas", "map", "datalist", "progress"}
_CONTAINERS = {"html", "body", "div", "section", "article", "main", "td", "table", "tbody", "tr", "center", "blockquote", "header", "figure", "details", "fieldset"}
#: Elements around the whole page, and those that may stand beside its text there.
_FRAME = {"", "html", "body"}
_BOXES = {"div", "td", "center"}
_LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that lay out a page and are no part of a text by their tag.
_SIDE = {"div", "ul", "ol", "td", "center", "p"}
#: An opening tag that ends an open element of these.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "body": set()}

#: Words of classes and ids, and roles, that mark what is not the article.
_AWAY = set(
    """nav navbar navigation menu sidebar footer breadcrumb breadcrumbs pagination pager ad ads advert adverts advertisement advertising sponsor sponsored
    promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert comment comments disqus reply replies respond discussion
    share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget toolbar masthead
    topbar search skip copyright legal outbrain taboola paywall""".split()
)
_TOP = {"header", "masthead", "banner", "topbar"}
_KEEPS = {"with", "has", "no", "without", "page", "article", "post", "entry", "main"}
_COMMENTS = {"comment", "comments", "disqus", "reply", "replies", "respond"}
#: Words that name adverts and nothing else; words of the page's frame; words that add nothing to a name.
_ADVERTS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsored", "promo", "disqus", "outbrain", "taboola"}
_AROUND = {"nav", "navbar", "navigation", "menu", "sidebar", "footer", "breadcrumb", "breadcrumbs", "pagination", "pager", "masthead", "topbar", "popup", "modal"}
_PLAIN = set("site box slot wrap wrapper container block unit area list bar buttons links section form thread count left right top bottom inner outer body content".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}


@dataclass
class Node:
    tag: str
    parent: int
    path: int  # number of its generalised path in the page, see :class:`Page`
    away: bool
    inline: bool = False
    score: float = 0.0
    kept: int = 0  # blocks that are more than a link
    mark: str = ""  # what its names say: "sure", "comments", "class", "id" or "part" (of a longer name)
    first: int = 0  # blocks below it
    last: int = -1
    within: int = -1  # the article or main element that it stands in
    named: bool = False  # has a class or id
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[tuple[int, str, int]]  # node, text, letters in links
    #: Numbers of paths by the parent's number and the last step, so that deep pages stay small.
    paths: dict[tuple[int, str], int]

    def path_of(self, k: int) -> str:
        """The whole path of a node."""
        step = {number: name for (_, name), number in self.paths.items()}
        names = []
        while k > 0:
            names.append(step[self.nodes[k].path])
            k = self.nodes[k].parent
        return "".join(f"/{name}" for name in reversed(names))

    def number_of(self, path: str) -> int | None:
        """The number of a whole path; None if the page has no such element."""
        at: int | None = 0
        for name in path.split("/")[1:]:
            at = self.paths.get((at, name))
            if at is None:
                return None
        return at


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _words(names: str) -> list[str]:
    return [w.lower() for w in _PARTS.findall(names)]


def _is_away(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether tag, role or style say that an element is none of the article; ``inside``: it stands in an article or main element."""
    if tag in _DROPPED or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    return attributes.get("role", "").lower() in _ROLES


def _mark(tag: str, attributes: dict[str, str], inside: bool, framed: bool) -> str:
    """What class and id say, see :class:`Node`; ``framed``: it stands in the body itself."""
    if not attributes or tag in ("html", "body", "main") or (inside and (tag in _LEAVES or tag in _INLINE)):
        return ""
    found = ""
    for kind, names in (*(("class", c) for c in attributes.get("class", "").split()), ("id", attributes.get("id", "") if tag not in _LEAVES else "")):
        words = set(_words(names))
        marks = _AWAY & words | ({"header"} & words if not inside and tag != "h1" else set())
        if not marks or not (marks & _COMMENTS or (tag != "article" and not _KEEPS & words)):
            continue
        rest = words - marks - _PLAIN
        if marks & _COMMENTS and not rest - _KEEPS:
            found = "comments"
        elif rest:
            found = found or "part"
        elif (kind == "class" and (len(marks) > 1 or marks & _ADVERTS)) or (not inside and (marks & _AROUND or (framed and marks & (_TOP | _ADVERTS)))):
            return "sure"
        elif found != "comments":
            found = kind
    return found


def _judge(page: Page) -> None:
    """Leaves out the marked elements that a second sign confirms.

    Where an article or main element holds half of the text, a mark outside of it is
    enough. Elsewhere the sign is a name of two such words or of adverts, text that is
    mostly links, a form with hardly any text, or a place at the edge of the article:
    there a class that says nothing else is believed of a box without a heading, and
    comments are.
    """
    nodes, blocks = page.nodes, page.blocks
    if not any(n.mark for n in nodes):
        return
    marked, headed, formed = [False] * len(nodes), [False] * len(nodes), [False] * len(nodes)
    for k, node in enumerate(nodes):
        node.last = len(blocks) if node.last < 0 else node.last
        marked[k] = bool(node.mark) or (node.parent >= 0 and marked[node.parent])
    for k in range(len(nodes) - 1, 0, -1):
        headed[nodes[k].parent] |= headed[k] or nodes[k].tag in _HEADINGS
        formed[nodes[k].parent] |= formed[k] or nodes[k].tag == "form"
    plain, size, linked = [0], [0], [0]
    for node, text, links in blocks:
        plain.append(plain[-1] + (not marked[node]))
        size.append(size[-1] + len(text))
        linked.append(linked[-1] + min(links, len(text)))
    in_article = sum(len(text) for node, text, _ in blocks if nodes[node].within >= 0 or nodes[node].tag in ("article", "main"))
    has_article = 2 * in_article >= size[-1] > 0
    for k, node in enumerate(nodes):
        node.away |= node.parent >= 0 and nodes[node.parent].away
        if node.away or not node.mark:
            continue
        if node.mark == "sure" or node.inline or (has_article and node.within < 0):
            node.away = True
            continue
        at = node.within if node.within >= 0 else node.parent
        low, high, first, last = nodes[at].first, nodes[at].last, node.first, node.last
        edge = plain[high] > plain[low] and (plain[first] == plain[low] or plain[high] == plain[last])
        alone = node.mark == "class" or (node.mark == "id" and node.within < 0)
        node.away = (
            2 * (linked[last] - linked[first]) >= size[last] - size[first]
            or (formed[k] and (node.mark == "comments" or last - first <= 2))
            or (edge and (node.mark == "comments" or (alone and node.tag in _SIDE and not headed[k])))
        )
    page.blocks = [b for b in blocks if not nodes[b[0]].away]


def parse(text: str) -> Page:
    """Elements and text blocks of a page; unclosed and misnested tags are accepted.

    Time is linear in the tags, however deep they nest: an element knows the article it
    stands in, and the open elements of every tag are at hand by their depth.
    """
    nodes = [Node("", -1, 0, False)]
    paths: dict[tuple[int, str], int] = {}
    depths: dict[str, list[int]] = {}  # depths in the stack by tag
    solid = [0]  # depths of what is not inline
    blocks: list[tuple[int, str, int]] = []
    stack = [0]
    pieces: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal links
        if pieces:
            block = " ".join("".join(pieces).split())
            pieces.clear()
            if block:
                blocks.append((stack[-1], block, links))
        links = 0

    def close(depth: int) -> None:
        if solid[-1] >= depth:
            flush()
        while len(stack) > depth:
            k = stack.pop()
            nodes[k].last = len(blocks)
            depths[nodes[k].tag].pop()
            if not nodes[k].inline:
                solid.pop()

    def add(raw: str) -> None:
        nonlocal links
        if raw and not nodes[stack[-1]].away:
            raw = html.unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if linked:
                links += len(raw)

    at, size, tags_end = 0, len(text), text.rfind(">") + 1
    while at < size:
        m = _TAG.search(text, at) if at < tags_end or "<!--" in text[at:] else None
        if m is None:
            add(text[at:])
            break
        add(text[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                linked = 0
            opened = depths.get(tag)
            if opened and (tag not in _INLINE or opened[-1] > solid[-1]):
                close(opened[-1])
            continue
        if tag in _RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(text, at)
            at = end.end() if end else size
            continue
        if tag in _VOID:
            if tag in ("br", "wbr", "img", "input"):
                if tag == "br" and pieces:
                    pieces.append(" ")
            elif tag == "hr":
                flush()
            continue
        inline = tag in _INLINE
        attributes = _attributes(m[3]) if m[3].strip() else {}
        parent = stack[-1]
        within = parent if nodes[parent].tag in ("article", "main") else nodes[parent].within
        inside = within >= 0
        away = _is_away(tag, attributes, inside)
        mark = _mark(tag, attributes, inside, nodes[stack[-1]].tag in _FRAME)
        away |= inline and bool(mark)
        if tag == "a":
            linked = 1
        if inline and not away:
            if tag == "text" and pieces:
                pieces.append(" ")
            continue
        if not inline:
            linked = linked if tag == "a" else 0
            if tag in _ENDS:  # items end items up to their list
                stop = max((depths[t][-1] for t in _STOPS[tag] if depths.get(t)), default=0)
                ended = [d[k] for t in (*_ENDS[tag], "p") if (d := depths.get(t)) and (k := bisect_right(d, stop)) < len(d)]
                if ended:
                    close(min(ended))
            while nodes[stack[solid[-1]]].tag == "p":  # a block ends an open paragraph
                close(solid[-1])
            flush()
        names = sorted({re.sub(r"\d+", "#", c).replace("/", "|") for c in attributes.get("class", "").split()})
        parent = stack[-1]
        within = parent if nodes[parent].tag in ("article", "main") else nodes[parent].within
        path = paths.setdefault((nodes[parent].path, ".".join([tag, *names])), len(paths) + 1)
        named = bool(attributes.get("class") or attributes.get("id"))
        nodes.append(Node(tag, parent, path, away or nodes[parent].away, inline, mark=mark, first=len(blocks), within=within, named=named))
        nodes[parent].children.append(len(nodes) - 1)
        depths.setdefault(tag, []).append(len(stack))
        if not inline:
            solid.append(len(stack))
        stack.append(len(nodes) - 1)
    flush()
    page = Page(nodes, blocks, paths)
    _judge(page)
    return page


def _score(page: Page) -> None:
    for node, block, links in page.blocks:
        page.nodes[node].score += max(0, len(block) - 2 * links)
        page.nodes[node].kept += links < len(block)
    for node in reversed(page.nodes[1:]):  # parents stand before their children
        page.nodes[node.parent].score += node.score
        page.nodes[node.parent].kept += node.kept


def _may_enter(page: Page, at: int, inner: int) -> bool:
    """Whether an element may be left for its child: nothing but links stays outside, or named boxes beside the text in the body."""
    nodes = page.nodes
    outer, child = nodes[at], nodes[inner]
    if outer.tag == "article" or child.tag in _LEAVES or not child.score:
        return False
    if child.kept == outer.kept:
        return True
    if outer.tag not in _FRAME or child.score < MOST * outer.score:
        return False
    beside = [k for k in outer.children if k != inner and nodes[k].kept]
    boxes = all(nodes[k].tag in _BOXES and nodes[k].named and nodes[k].path != child.path for k in beside) and not _titled(page, at).intersection(beside)
    return boxes and sum(nodes[k].kept for k in beside) + child.kept == outer.kept


def _titled(page: Page, root: int) -> set[int]:
    """Children of an element that hold a top heading with text."""
    holds = [node.tag == "h1" and node.kept > 0 for node in page.nodes]
    for k in range(len(holds) - 1, 0, -1):
        holds[page.nodes[k].parent] |= holds[k]
    return {k for k in page.nodes[root].children if holds[k]}


def best_path(page: Page) -> str | None:
    """Path of the lowest container that holds the page's article."""
    _score(page)
    at = 0
    if not page.nodes[0].score:
        return None
    best = 0
    while True:
        inner = max(page.nodes[at].children, key=lambda k: page.nodes[k].score, default=None)
        if inner is None or not _may_enter(page, at, inner):
            return page.path_of(best)
        at = inner
        if page.nodes[at].tag in _CONTAINERS:
            best = at


def _chosen(own: str | None, path: str) -> str:
    """The host's path, or the page's own below the body where that one is an ancestor with more of the article."""
    if own is None:
        return path
    last = own.rsplit("/", 1)[-1].split(".")[0]
    return own if path.startswith(f"{own}/") and last not in _FRAME else path


def text_at(page: Page, path: str) -> str | None:
    """Blocks below the elements of a path in page order, one a line; None if the page has no such element."""
    number = page.number_of(path)
    if number is None:
        return None
    below = [False] * len(page.nodes)
    found = False
    for k, node in enumerate(page.nodes):
        own = node.path == number and not node.away
        found |= own
        below[k] = own or (node.parent >= 0 and below[node.parent])
    if not found:
        return None
    return "\n".join(block for node, block, _ in page.blocks if below[node])


def host_of(url):
    """Host of an address without user, port and a leading ``www.``; empty when there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def _votes(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes = [], []
            for k in range(len(batch)):
                page = parse(batch.column("html")[k].as_py() or "")
                paths.append(best_path(page))
                sizes.append(int(page.nodes[0].score))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["host", "path", "size"])

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, size bigint")


def winners(pages: DataFrame) -> DataFrame:
    """``host, path``: the path with most votes, then most text; pages without a host vote for none."""
    votes = _votes(pages).where("path is not null and host <> ''").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("size").alias("size"))
    return votes.groupBy("host").agg(F.max(F.struct("votes", "size", "path"))["path"].alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row.

    A null or empty page, or one without text outside what is left out, has the empty
    text. Pages without a host use their own best container. Rows that repeat a page
    count as often in the vote and are extracted each. Columns other than ``page_id``,
    ``url`` and ``html`` are not read. An empty table gives no rows. A page of any length
    or depth is parsed whole, in time linear in its tags.
    """
    chosen = write_table(winners(pages), "winners")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("_host"))
    joined = rows.join(chosen.withColumnRenamed("host", "_host"), "_host", "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for k in range(len(batch)):
                page, path = parse(batch.column("html")[k].as_py() or ""), batch.column("path")[k].as_py()
                own = best_path(page)
                text = text_at(page, _chosen(own, path)) if path else None
                if not text:
                    text = text_at(page, own) if own is not None else "\n".join(b for _, b, _ in page.blocks)
                texts.append(text or "")
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
