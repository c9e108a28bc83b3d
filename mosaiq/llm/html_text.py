"""Main-text extraction from HTML by composite text density."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import table

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr button math mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover mpadded mphantom merror mfenced menclose mtable mtr mtd semantics".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: An element that an opening tag closes, and where the search for it ends.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements whose content isn't text of the page.
DROPPED = frozenset("head script style noscript template iframe object embed svg canvas audio video button select textarea input datalist annotation annotation-xml".split())
#: Elements that are main text only where nothing else is.
ASIDE = frozenset("nav footer aside dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark what isn't main text.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar rail aside footer masthead topbar toolbar header cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended recommendations "
    "comment comments commentlist respond responses feedback disqus replies reply discussion pagination pager widget widgets skip copyright complementary contentinfo search disclaimer".split()
)

#: Of these, the words that no part of a text is named after.
ALWAYS_DROPPED = frozenset("ad ads advert adverts sponsored comment comments commentlist respond disqus".split())
#: Only such elements are dropped for their names; headings, paragraphs and other text blocks never are.
CONTAINERS = frozenset("div section ul ol dl table header hgroup fieldset details center address figure".split())
#: A list or container of links is a menu if its links have so many characters each, at most.
MENU_LINK = 30

#: With these a header is the text's own, and a name tells what a container has beside it.
TITLED = frozenset("article post entry content story".split())
ABOUT = frozenset("has with no without free open closed enabled disabled allowed count off on".split())
#: Headings with these words introduce links to other pages, not a list of the text's own.
ELSEWHERE = frozenset("related recommended recommendations more also share follow tags categories navigation menu latest popular trending links next previous sponsored comments".split())
#: What stands beside the best subtree joins it with so much of its density sum.
SIBLING = 0.25

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Node:
    __slots__ = ("chars", "density", "doubt", "dropped", "inside", "items", "link_chars", "link_tags", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, doubt: str = ""):
        self.tag, self.parent, self.dropped, self.doubt = tag, parent, dropped, doubt
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)  # the text's own element
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def in_sentence(n: Node) -> bool:
    """Whether text stands before the end of ``n``, a text block or what marks up part of one."""
    while n.tag in INLINE and n.parent and not any(isinstance(x, str) and x.strip() for x in n.items):
        n = n.parent
    return (n.tag in INLINE or n.tag in HEADINGS or n.tag in ("p", "li", "td", "dd")) and any(isinstance(x, str) and x.strip() for x in n.items)


def _boilerplate(tag: str, attributes: str, parent: Node) -> tuple[bool, str]:
    """Whether an element is dropped, or else the doubt about it that ``settle`` decides: "form"; "name" of a
    container that text seldom has; "topic", a name that a part of a text may have; "always"; or none."""
    known: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes or ""):
        known.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in known or known.get("aria-hidden", "").strip().lower() == "true" or _NO_DISPLAY.search(known.get("style", "")):
        return True, ""
    if tag == "form":
        return False, "form"
    if tag in DROPPED:
        return tag != "button" or not in_sentence(parent), ""
    inside = parent.inside
    if tag in ASIDE or tag == "header" and not inside:  # an article's own header holds its title
        return False, "always"
    if tag not in CONTAINERS and "-" not in tag:
        return False, ""
    doubt = ""
    for name in ("class", "id", "role"):
        each = [{w.lower() for w in _PART.findall(x)} for x in known.get(name, "").split()]
        named = set().union(*each)
        found = set().union(*(x for x in each if not x & ABOUT)) & DROPPED_WORDS  # others only tell of a sidebar
        if not found or found == {"header"} and (inside or named & TITLED):
            continue  # the text's own header
        if found & ALWAYS_DROPPED:
            return False, "always"
        topic = name != "role" and (tag == "section" or name == "id")
        doubt = "topic" if topic and doubt != "name" else "name"
    return False, doubt


def parse(html: str) -> tuple[Node, list[Node]]:
    """A tree of the page and its nodes, parents first. Never fails: stray ends are ignored, open elements
    end with their parents, and a tag or comment that the page's end cuts off ends there."""
    root = Node("#root", None, False)
    nodes, stack, at = [root], [root], 0
    opened: Counter[str] = Counter()

    def close(k: int) -> None:
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:]

    while True:
        m = _TOKEN.search(html, at)
        if text := html[at : m.start() if m else None]:
            if not stack[-1].dropped:
                stack[-1].items.append(unescape(text))
        if not m:
            return root, nodes
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            for k in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[k].tag == tag:
                    close(k)
                    break
        elif m[2]:
            tag = m[2].lower()
            if tag in CLOSES_P and opened["p"] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag not in INLINE:
                        break
            elif tag in CLOSES:
                ends, walls = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1) if any(opened[x] > 0 for x in ends) else ():
                    if stack[k].tag in ends:
                        close(k)
                        break
                    if stack[k].tag in walls:
                        break
            node = Node(tag, stack[-1], True) if stack[-1].dropped else Node(tag, stack[-1], *_boilerplate(tag, m[3], stack[-1]))
            stack[-1].items.append(node)
            nodes.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                if not node.dropped:
                    node.items.append(html[at : end.start() if end else None])
                at = end.start() if end else len(html)
                if not end:
                    return root, nodes
                stack.append(node)
                opened[tag] += 1
            elif tag not in VOID and not m[0].endswith("/>"):
                stack.append(node)
                opened[tag] += 1


def measure(nodes: list[Node]) -> Node:
    """Set every node's density and the sum of its children's; returns the body (or the root).

    Density is characters per tag, adjusted by links: a base that grows with the node's share of link
    characters and with the page's takes the logarithm of how seldom links are. A block without blocks has
    its own density as its sum."""
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    for n in nodes:
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        n.density = n.sum = 0.0
    for n in reversed(nodes):
        if n.dropped:
            continue
        n.chars += sum(len("".join(x.split())) for x in n.items if isinstance(x, str))
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
        if p := n.parent:
            p.chars += n.chars
            p.tags += n.tags + 1
            p.link_chars += n.link_chars
            p.link_tags += n.link_tags
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for n in nodes:
        if n.dropped or not n.chars:
            continue
        c, t, lc, lt = n.chars, n.tags or 1, n.link_chars or 1, n.link_tags or 1
        base = math.log(c / max(1, c - n.link_chars) * n.link_chars + ratio * c + math.e)
        n.density = c / t * max(0.0, math.log(c / lc * t / lt) / math.log(max(base, 1.0) + 1e-9) if base > 1 else math.log(c / lc * t / lt + 1))
        if n.parent and n.tag not in INLINE:  # a paragraph's text counts once, however it is marked up
            n.parent.sum += n.density
    for n in nodes:
        n.sum = n.sum or n.density
    return body


def ancestor_path(n: Node) -> Iterator[Node]:
    while n.parent:
        n = n.parent
        yield n


def children(n: Node) -> list[Node]:
    """The blocks right below a node that have text."""
    return [x for x in n.items if isinstance(x, Node) and not x.dropped and x.chars and x.tag not in INLINE]


def titled(n: Node) -> bool:
    """Whether all text of a block is headings."""
    todo = [n]
    while todo:
        x = todo.pop()
        if x.tag not in HEADINGS:
            below = children(x)
            if not below or sum(y.chars for y in below) != x.chars:
                return False
            todo.extend(below)
    return True


def content(body: Node, nodes: list[Node]) -> set[int]:
    """Ids of the nodes whose subtrees are main text.

    The subtree of the greatest density sum is; an <article> that holds it is as a whole. The threshold is the
    least density on its path to the body. On each level of that path, what stands beside joins it: containers
    of blocks that reach the threshold, are not mostly links and have SIBLING of the greatest sum; below the body, text
    blocks that are not mostly links; headings right before. Within <main> containers need not reach the threshold. Nothing else of the page does."""
    inside = [n for n in nodes if not n.dropped and n.chars and n.tag not in INLINE]
    if not inside:
        return set()
    best = max(inside, key=lambda n: n.sum)
    if not best.sum:
        return {id(body)}
    path = [best, *ancestor_path(best)]
    if body in path:
        path = path[: path.index(body) + 1]
    least = min((n.density for n in path if n.density), default=0.0)
    at = max((k for k, n in enumerate(path) if n.tag == "article"), default=0)
    found = {id(path[at])}

    def joins(x: Node, beside: Node, level: Node) -> bool:
        if x.link_chars > 0.5 * x.chars:
            return False
        if level.inside:
            return x.tag not in HEADINGS and (x.tag not in CONTAINERS or x.sum >= best.sum * SIBLING or any(y.tag == "p" for y in children(x)) and x.density >= SIBLING * least)
        if x.tag in ("article", "section") and x.tag == beside.tag:
            return x.density >= SIBLING * least
        if x.tag in CONTAINERS or "-" in x.tag or x.tag in ("article", "main"):
            return bool(children(x)) and x.density >= least and x.sum >= SIBLING * best.sum
        return level is not body and x.tag not in HEADINGS

    for beside, level in zip(path[at:], path[at + 1 :], strict=False):
        row = children(level)
        place = row.index(beside)
        found |= {id(x) for x in row if x is not beside and not menu(x) and joins(x, beside, level)}
        first = min(k for k, x in enumerate(row) if x is beside or id(x) in found)
        while first and titled(row[first - 1]) and first <= place:
            first -= 1
            found.add(id(row[first]))
    return found


def settle(body: Node, nodes: list[Node]) -> None:
    """Decide the doubts. A form or named container stays if it holds the greatest density sum or most of the
    text, one named after comments or advertisements only if it holds the greatest sum and what is left without it has no
    <article>, <main> or <h1> and less than SIBLING of that sum; a part of the text that is named like
    boilerplate stays unless it is mostly links. All nodes must have been measured; they are measured anew."""
    doubted = [n for n in nodes if n.doubt and not n.dropped]
    if not doubted:
        return
    inside = [n for n in nodes if not n.dropped and n.chars and n.tag not in INLINE]
    best = max(inside, key=lambda n: n.sum, default=body)
    held = {id(best), *map(id, ancestor_path(best))}
    half = (body.chars - body.link_chars) / 2
    marks = [n.dropped for n in nodes]

    def drop(stays) -> None:
        for n, mark in zip(nodes, marks, strict=True):
            n.dropped = mark or bool(n.parent and n.parent.dropped) or bool(n.doubt) and not stays(n)
        measure(nodes)

    mostly = {id(n) for n in doubted if id(n) in held or n.chars - n.link_chars > half}
    links = {id(n) for n in doubted if n.link_chars > 0.5 * n.chars}
    whole = {id(n) for n in doubted if n.doubt != "always" and id(n) in mostly}
    most = best.sum
    drop(lambda n: id(n) in whole)
    if not body.chars:
        drop(lambda n: True)
        return
    left = [n for n in nodes if not n.dropped and n.chars and n.tag not in INLINE]
    if not any(n.tag in ("article", "main", "h1") for n in left) and max(n.sum for n in left) < SIBLING * most:
        own = {id(n) for n in doubted if n.doubt == "always" and id(n) in held and n.tag in CONTAINERS and n.tag != "header"}
        if own:
            whole |= own
            drop(lambda n: id(n) in whole)
    topics = [n for n in doubted if n.doubt == "topic" and id(n) not in links]
    if topics:
        chosen = content(body, nodes)
        within: set[int] = set()  # what lies in main text, parents first
        for n in nodes:
            p = n.parent
            if p and (id(p) in within or p.inside or id(p) in chosen and p is not body and p.parent):
                within.add(id(n))
        whole |= {id(n) for n in topics} & within
        drop(lambda n: id(n) in whole)


def menu(n: Node) -> bool:
    """Whether a list or another container is mostly short links."""
    return n.tag in CONTAINERS and n.link_tags > 2 and n.link_chars > 0.7 * n.chars and n.link_chars <= MENU_LINK * n.link_tags


def introduces(n: Node) -> bool:
    """Whether a heading announces a list of the text's own, not links to other pages."""
    said = "".join(x for x in n.items if isinstance(x, str))
    return n.tag in HEADINGS and not {w.lower() for w in _PART.findall(said)} & ELSEWHERE


def blocks(node: Node) -> list[str]:
    """The text of a subtree by block, references decoded and white space as single spaces."""
    out: list[str] = []
    held: list[str] = []

    def below(n: Node) -> Iterator[Node | str | None]:
        """What stands in a node, without its menus; a list that a heading introduces is none."""
        before: Node | None = None
        for x in n.items:
            if isinstance(x, str):
                before = None if x.strip() else before
            elif x.dropped or menu(x) and not (n.inside and before and introduces(before)):
                yield None if x.tag not in INLINE else ""
                continue
            elif x.chars:
                before = x if x.tag not in INLINE else None
            yield x

    def close() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            held.append(x)
        elif x.tag in INLINE:
            todo.extend(reversed(list(below(x))))
        elif not x.dropped:
            todo.append(None)
            todo.extend(reversed(list(below(x))))
            todo.append(None)
    close()
    return out


def extract(html: str | None) -> str:
    """The main text of a page; null, empty and pages without text give an empty string."""
    if not html:
        return ""
    _, nodes = parse(html)
    body = measure(nodes)
    settle(body, nodes)
    found = content(body, nodes)
    return " ".join(b for n in nodes if id(n) in found for b in blocks(n))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row's whole html, in one pass without a shuffle.

    Null and empty html: empty text. Repeated rows, null ids and null urls are kept as they are; an
    empty table gives an empty result; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(h.as_py()) for h in b.column("html")]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_density(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
