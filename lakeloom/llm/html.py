"""Main text of web pages by composite text density.

Each page is read into a tree of elements. Every node gets its characters, tags,
link characters and link tags; its composite density is characters a tag,
adjusted by the share of link text against the body's own. The density sum of a node adds
its children's densities. The node with the largest sum is the main subtree; the least density on the path from the body
down to it is the threshold. Density alone chooses it. An ``article`` or ``main`` around it is taken whole only if the subtree is most of its text. Without one the
subtree grows over blocks beside it whose own text is as dense as its own, and headings before them; what else stands there is left out. Inside it, blocks of links below the threshold,
readers' comments, adverts and copyright lines that say what they are, and headings of what is dropped go, and so do the parts that names mark (``nav``, ``aside``, class ``ad``): marks can't make a node
the main one, and count for nothing where they would take the page's article or most of its text.
The text is given block by block. Pages are independent rows: one narrow step, no shuffle. Reading takes time in proportion to a page's
length, whatever is in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_text

#: One attribute (name and value), or the end of the tag. A quote that is never closed ends the match before its value.
_ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(?![\"'])([^\s>]*)))?)")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Elements whose content is no text of a page.
_NEVER = frozenset("script style noscript template head title button select option optgroup datalist textarea input iframe object svg canvas audio video noembed noframes".split())
#: Elements that are measured, but part of no main text.
_OUTSIDE = frozenset("nav footer aside form dialog menu".split())
#: Deeper elements follow each other at this depth.
_DEEPEST = 512
#: Elements whose start and end part blocks.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open element of the left kind ends when one of the right kinds begins.
_P_ENDS = _BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
_SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table tr td th body html article section main div".split())
#: Words of a class, id or role that mark what isn't main text.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav footer masthead toolbar pagination pager"
    " comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay"
    " share sharing social newsletter subscribe subscription signup login related recommended recommendations widget complementary contentinfo search".split()
)
#: Words that may stand beside a mark in one name: 'site-nav' is a mark, 'has-sidebar' and 'share-price' aren't.
_BESIDE = frozenset(
    "site main top left right bottom upper lower primary secondary global page post posts article articles entry list area section box container"
    " wrapper wrap bar block slot unit inner outer item items link links button buttons icon icons form header text message group panel col column js id".split()
) | {""}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PHRASE_END = _HEADINGS | {"p"}
#: Class names that promise an article.
_HINTS = frozenset("post entry article story post-content entry-content article-body article-content story-body post-body".split())
#: Blocks beside the main subtree are text if they are at least so dense, as a share of its own blocks.
_LEVEL = 0.8
_TEXT = _PHRASE_END | frozenset("ul ol dl pre blockquote table figure".split())
_EMPTY: frozenset[str] = frozenset()
#: Blocks that are dropped as a whole if they are mostly links.
_GROUPS = frozenset("div section ul ol dl p table center header pre blockquote details".split())
#: How a block of comments starts.
_COMMENTS = re.compile(
    r"(?:\d+ |all |latest |recent )?(?:reader|user|visitor|viewer)?s?['\u2019]?s? ?(?:comments?|replies|responses)(?: \(?\d+\)?| from .*)?\W*"
    r"|what (?:our |the |other )?(?:readers|users|visitors|people|others) (?:say|said|are saying|think|wrote)\W*|(?:leave|write|post|add) (?:a|your) (?:comment|reply)\W*|join the (?:discussion|conversation)\W*",
    re.I,
)
#: How adverts and copyright lines start.
_NOTICE = re.compile(r"(?:©|\(c\) |copyright\b|all rights reserved|advertisements?\b|advertorial\b|sponsored\b|promoted (?:by|content|post)|anzeige\b|publicité\b|publicidad\b|werbung\b)", re.I)
_SPEAKER = frozenset("b strong cite a span time em i".split())
_SAID = re.compile(r"\b(?:says|said|writes|wrote|replied|commented|posted|ago)\b", re.I)


class _Node:
    __slots__ = ("tag", "parts", "skip", "marked", "hinted")

    def __init__(self, tag: str, skip: bool, marked: bool = False) -> None:
        self.tag, self.skip, self.marked, self.hinted = tag, skip, marked, False
        self.parts: list[str | _Node] = []


def _is_mark(name: str) -> bool:
    """Whether one class name, id or role is a mark, alone or beside words that don't change its meaning."""
    words = set(re.split(r"[^a-z]+", name))
    return not _MARKS.isdisjoint(words) and words <= _MARKS | _BESIDE


def _flags(attributes: list[tuple[str, str]]) -> tuple[bool, bool]:
    """(hidden, marked)."""
    hidden = marked = False
    for name, value in attributes:
        name = name.lower()
        if name in ("hidden", "aria-hidden", "style", "class", "id", "role"):
            value = value.lower()
            hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
            marked |= name in ("class", "id", "role") and any(map(_is_mark, value.split()))
    return hidden, marked


def _weigh(node: _Node, through: bool) -> tuple[int, bool]:
    """Characters outside links, and whether they stand in an unmarked article; ``through`` looks into marked elements."""
    plain, article, stack = 0, False, [(node, False)]
    while stack:
        x, inside = stack.pop()
        inside = inside or x.tag in ("article", "main") and not x.marked
        for part in x.parts:
            if isinstance(part, str):
                chars = len(" ".join(part.split()))
                plain += chars
                article |= inside and chars > 0
            elif part.tag != "a" and (not part.skip or through and part.marked):
                stack.append((part, inside))
    return plain, article


def _restore(root: _Node, marked: list[_Node]) -> None:
    """Takes back marks, the outermost first, where they hide the only article or most of the text of a page without one."""
    whole, (_, article) = _weigh(root, True)[0], _weigh(root, False)
    for node in marked:
        if article:
            break
        plain, holds = _weigh(node, True)
        if holds or plain * 2 > whole:
            node.skip = False
            article = _weigh(root, False)[1]


def _tag(html: str, at: int) -> tuple[list[tuple[str, str]], bool, int]:
    """The attributes of a tag from ``at`` on, whether it closes itself, and where it ends (-1: never)."""
    attributes: list[tuple[str, str]] = []
    while (m := _ATTRIBUTE.match(html, at)) and not m[1]:
        at = m.end()
        attributes.append((m[2], m[3] or m[4] or m[5] or ""))
    if m:
        return attributes, html[m.end() - 2] == "/", m.end()
    return attributes, False, -1


def _tokens(html: str) -> Iterator[tuple[str, str, list[tuple[str, str]], bool, int]]:
    """(kind, name or text, attributes, closes itself, where it ends): kind is "text", "start" or "end". Comments and declarations go.

    A sender may answer with a place to go on from. A tag that the page's end cuts off is no text.
    """
    at = begun = 0
    n = len(html)
    while at < n:
        lt = html.find("<", at)
        after = html[lt + 1 : lt + 2] if lt >= 0 else ""
        name = _NAME.match(html, lt + 2 if after == "/" else lt + 1) if lt >= 0 else None
        if lt >= 0 and not name and after not in ("!", "?", "/"):
            if after:
                at = lt + 1
                continue
            lt = -1  # a sign at the very end
        if lt < 0:
            yield "text", html[begun:], [], False, n
            return
        if lt > begun:
            yield "text", html[begun:lt], [], False, lt
        if name:
            attributes, own, end = _tag(html, name.end())
            if end < 0:
                return
            to = yield "end" if after == "/" else "start", name[0].lower(), attributes, own, end
            at = begun = to or end
            continue
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 2)
            at = begun = end + 3 if end >= 0 else n
        else:
            end = html.find(">", lt)
            at = begun = end + 1 if end >= 0 else n


def parse(html: str) -> _Node:
    """The tree of a page. Unclosed and misplaced tags are mended as browsers mostly do."""
    root = _Node("html", False)
    stack, marks = [root], []
    tokens, to = _tokens(html), None
    while True:
        try:
            kind, tag, attributes, own, end = tokens.send(to)
        except StopIteration:
            break
        to = None
        if kind == "text":
            stack[-1].parts.append(tag)
            continue
        if kind == "end":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in _BLOCK and stack[k].tag in _BLOCK and tag not in _NEVER:
                    break  # a stray end of an inline element ends no block
            continue
        if tag in ("html", "body", "head") and any(x.tag == tag for x in stack):
            continue
        if tag == "body" or tag in _BLOCK and stack[-1].tag == "head":
            while len(stack) > 1:  # the head has ended, with or without its tag
                stack.pop()
        if tag in _P_ENDS:
            for k in range(len(stack) - 1, 0, -1):
                open_tag = stack[k].tag
                if open_tag == "p" or open_tag in _PHRASE_END and tag in _PHRASE_END:
                    del stack[k:]
                    break
                if open_tag in _BLOCK:
                    break
        if tag in _SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                open_tag = stack[k].tag
                if tag in _SIBLINGS.get(open_tag, _EMPTY):
                    del stack[k:]
                    break
                if open_tag in _SCOPES and open_tag not in _SIBLINGS:
                    break
        if len(stack) >= _DEEPEST:
            stack.pop()
        kept_tag = tag in ("html", "body") or tag in ("article", "main") and not any(x.tag == "article" for x in stack)
        hidden, marked = _flags(attributes) if attributes else (False, False)
        in_article = tag == "header" and any(x.tag in ("article", "main") for x in stack)
        never = tag in _NEVER or hidden and not kept_tag
        outside = tag in _OUTSIDE and tag != "form" or tag == "header" and not in_article
        node = _Node(tag, never or outside or (marked or tag == "form") and not kept_tag, (marked or tag == "form") and not never and not outside)
        node.hinted = any(name.lower() == "class" and not _HINTS.isdisjoint(value.lower().split()) for name, value in attributes)
        if node.marked and node.skip:
            marks.append(node)
        if not never:
            stack[-1].parts.append(node)
        if tag in _VOID or own and tag not in _BLOCK:
            continue
        if tag in _RAW:
            m = _raw_end(tag).search(html, end)
            node.parts.append(html[end : m.start()] if m else html[end:])
            to = m.end() if m else len(html)
            continue
        stack.append(node)
    if marks:
        _restore(root, marks)
    return root


@cache
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{tag}(?:[\s/][^>]*)?>", re.I)


class _Measure:
    __slots__ = ("node", "chars", "tags", "link_chars", "link_tags", "children", "density", "total", "outside")


def measure(body: _Node) -> list[_Measure]:
    """Counts and densities of every node; children come before their parents, the body is the last."""
    order, stack = [], [(body, False, None)]
    while stack:
        node, linked, parent = stack.pop()
        m = _Measure()
        m.node, m.chars, m.tags, m.link_chars, m.link_tags, m.children = node, 0, 0, 0, 0, []
        m.outside = parent.outside or node.skip if parent else False
        linked = linked or node.tag == "a"
        for part in node.parts:
            if isinstance(part, str):
                chars = len(" ".join(part.split()))
                m.chars += chars
                m.link_chars += chars if linked else 0
        order.append((m, parent))
        stack.extend((part, linked, m) for part in node.parts if not isinstance(part, str))
    for m, parent in reversed(order):
        if parent is not None:
            parent.chars += m.chars
            parent.tags += m.tags + 1
            parent.link_chars += m.link_chars
            parent.link_tags += m.link_tags + (m.node.tag == "a")
            parent.children.append(m)
    found = [m for m, _ in reversed(order)]
    for m in found:
        m.density = _density(m, found[-1])
        # The text of a single block is its container's: a block without blocks has no sum.
        m.total = sum(c.density for c in m.children if c.node.tag in _BLOCK)
    return found


def _density(m: _Measure, body: _Measure) -> float:
    """Characters a tag, the less the more of the text are links."""
    if not m.chars:
        return 0.0
    tags, link_chars, link_tags = max(m.tags, 1), max(m.link_chars, 1), max(m.link_tags, 1)
    plain = max(m.chars - m.link_chars, 1)
    base = log(m.chars / plain * m.link_chars + body.link_chars / max(body.chars, 1) * m.chars + e)
    return m.chars / tags * log(m.chars / link_chars * tags / link_tags + e) / log(base + e)


def _is_menu(m: _Measure, threshold: float) -> bool:
    """A block below the threshold of several links, with no more than a few signs for each beside them; a paragraph with no letter beside them."""
    plain = m.chars - m.link_chars
    if m.node.tag not in _GROUPS or m.link_tags < 2 or plain * 2 > m.chars or plain > 4 * m.link_tags + 12 or m.density >= threshold:
        return False
    return m.node.tag != "p" or not any(isinstance(x, str) and any(map(str.isalpha, x)) for x in m.node.parts)


def _is_talk(m: _Measure, threshold: float) -> bool:
    """A container of comments: its first words say so, or it is below the threshold and its entries start with a name and speak."""
    if m.node.tag not in ("div", "section", "ul", "ol", "details"):
        return False
    blocks = [c for c in m.children if c.node.tag in _BLOCK and c.chars]
    if len(blocks) < 2:
        return False
    if blocks[0].chars <= 80 and _COMMENTS.fullmatch(" ".join(text_of(blocks[0].node).split())):
        return True
    named = [c for c in blocks if c.node.tag in ("div", "li", "section", "article") and _speaks(c.node)]
    return m.density < threshold and len(named) > 1 and len(named) + 1 >= len(blocks)


def _is_notice(m: _Measure) -> bool:
    """A short block that says itself what it is: an advert or a copyright line."""
    return m.node.tag in ("div", "section", "p", "span", "center", "small") and m.chars <= 300 and bool(_NOTICE.match(" ".join(text_of(m.node).split())))


def _speaks(entry: _Node) -> bool:
    """Whether an entry begins with a short inline element, a name, and soon tells that somebody spoke, or when."""
    if not (_SAID.search(" ".join(text_of(entry).split())[:80]) or any(not isinstance(x, str) and x.tag == "time" for x in entry.parts)):
        return False
    node, parts = entry, 0
    while True:
        inner = [x for x in node.parts if not isinstance(x, str) or x.strip()]
        if not inner or isinstance(inner[0], str):
            return False
        parts += len(inner) - 1
        node = inner[0]
        if node.tag in _SPEAKER:
            return parts > 0 and 0 < len(text_of(node)) <= 40


def _hinted(path: list[_Measure]) -> _Measure | None:
    """An element around the main subtree whose tag or class promises an article, if the subtree is most of its text: the outermost ``article``, else the nearest ``main`` or named one."""
    best = path[0]
    found = next((m for m in reversed(path) if m.node.tag == "article"), None) or next((m for m in path if m.node.tag == "main" or m.node.hinted), None)
    if found is None:
        return None
    outside = sum(c.chars for c in found.children if c.outside)
    return found if best.chars * 2 >= found.chars - found.link_chars - outside else None


def _has_blocks(m: _Measure) -> bool:
    return any(c.node.tag in _BLOCK and c.chars for c in m.children)


def _text_level(best: _Measure) -> float:
    """The density of the block in which the middle character of the subtree's blocks stands."""
    blocks = sorted((c.density, c.chars) for c in best.children if c.node.tag in _BLOCK and c.chars) or [(best.density, best.chars)]
    half, seen = sum(n for _, n in blocks) / 2, 0
    for density, n in blocks:
        seen += n
        if seen >= half:
            break
    return density


def _grown(best: _Measure, path: list[_Measure], threshold: float, dropped: set[int]) -> _Measure:
    """The lowest element of the path that holds the subtree and every block beside it that is as dense as its text, or a heading before it. The other blocks up to there are dropped."""
    level, top, beside, held = _LEVEL * _text_level(best), best, [], best
    for up in path[1:]:
        if up.outside:
            break
        kept_below = True  # what stands behind a heading is kept
        own = sum(len(" ".join(part.split())) for part in up.node.parts if isinstance(part, str))
        found = own >= level
        for c in reversed(up.children):
            if c is held:
                kept_below = True
                continue
            text = c.chars and not c.outside and c.link_chars * 2 < c.chars and not _is_talk(c, threshold)
            heading = c.node.tag in _HEADINGS and kept_below and bool(text)
            keep = heading or bool(text) and c.node.tag not in _HEADINGS and _text_level(c) >= level and not _is_notice(c) and (c.node.tag in _TEXT or _has_blocks(c) or c.chars * 2 >= best.chars)
            found |= keep
            if c.node.tag in _BLOCK and c.chars:
                kept_below = keep
            if not keep and c.node.tag in _BLOCK:
                beside.append(id(c.node))
        if found:
            top = up
            dropped.update(beside)
            beside = []
        held = up
    # Where the text stands in containers, a bare line between them is none of its paragraphs.
    plain = lambda m: m.chars - m.link_chars
    texts = [c for c in best.children if not c.outside and c.node.tag in _BLOCK]
    if 2 * sum(plain(c) for c in texts if _has_blocks(c)) >= sum(map(plain, texts)):
        dropped.update(id(c.node) for c in texts if c.node.tag in ("div", "section", "center") and not _has_blocks(c) and c.chars * 2 < best.chars and c.density < level)
    return top


def _drop_lone_headings(m: _Measure, dropped: set[int]) -> None:
    """Drops headings of which all blocks up to the next one are dropped, and at least one."""
    lost, kept = 0, False
    for c in reversed(m.children):
        if c.node.tag in _HEADINGS:
            if lost and not kept:
                dropped.add(id(c.node))
            lost, kept = 0, False
        elif c.chars:
            gone = id(c.node) in dropped or c.outside
            lost, kept = lost + gone, kept or not gone


def main_node(root: _Node) -> tuple[_Node, set[int]]:
    """The main subtree, and the ids of the nodes in it that aren't main text."""
    body = next((p for p in root.parts if not isinstance(p, str) and p.tag == "body"), root)
    measures = measure(body)
    top = measures[-1]
    parent = {id(c): m for m in measures for c in m.children}
    best = max((m for m in measures if m.total and not m.outside), key=lambda m: m.total, default=top)
    path, at = [best], best
    while id(at) in parent:
        at = parent[id(at)]
        path.append(at)
    threshold = min(m.density for m in path[1:] or path)
    dropped: set[int] = set()
    around = _hinted(path)
    if around is not None:
        best = around
    else:
        best = _grown(best, path, threshold, dropped)
    stack = [c for c in best.children if id(c.node) not in dropped]
    while stack:
        m = stack.pop()
        notice = m.node.tag != "p" and not _has_blocks(m) and _is_notice(m)
        if m.outside or m.chars * 2 < best.chars and (_is_menu(m, threshold) or _is_talk(m, threshold) or notice):
            dropped.add(id(m.node))
        else:
            _drop_lone_headings(m, dropped)
            stack.extend(c for c in m.children if id(c.node) not in dropped)
    _drop_lone_headings(best, dropped)
    return best.node, dropped


def text_of(node: _Node, without: set[int] | frozenset[int] = frozenset()) -> str:
    """Its blocks, one a line; white space inside a block is one space. Nodes with the ids ``without`` are left out."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        block = " ".join(unescape("".join(run)).split())
        run.clear()
        if block:
            blocks.append(block)

    stack: list[object] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif id(x) not in without:
            if x.tag == "br":
                run.append(" ")
            elif x.tag in _BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.parts))
    flush()
    return "\n".join(blocks)


def extract(html: str | None) -> str:
    """The main text of a page; empty for null, empty or text-less pages."""
    return text_of(*main_node(parse(html))) if html else ""


def main_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, ``url``, ``text``, ``n_chars``) for every row of ``pages``.

    A null page is read as empty; a page without main text gives the empty
    text. Repeated rows repeat in the result; an empty table gives no rows. Whole pages are read, whatever their length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [extract(h) for h in pdf["_html"]]
            yield pd.DataFrame({"_id": pdf["_id"], "_url": pdf["_url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(id_text(id_col), F.col("url").alias("_url"), F.col(html_col).alias("_html"))
    out = rows.mapInPandas(run, "_id string, _url string, text string, n_chars long")
    return out.select(id_back(pages, id_col), F.col("_url").alias("url"), "text", "n_chars")
