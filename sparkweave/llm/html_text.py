"""Main text of web pages by tree scoring.

A page is parsed into a tree of block elements. What is never article text (scripts, styles, forms, navigation,
footers, asides, hidden parts, and blocks whose class, id or role names a menu, advert, notice, comments and the like)
is pruned. Every paragraph, which is an element's own text, is worth 1 point, 1 for each comma and 1 for each 100
characters up to 3; it passes them to its parent whole, to the grandparent by half, and to the next ancestors, REACH in
all, divided by three times the distance. An ancestor's points are discounted by its link density. The best container is kept, or
the outermost ``article`` or ``main`` around it, and of its siblings those with a fifth of its points or long text
with few links. What is kept gives its blocks in page order.

White space inside a block becomes one space, blocks are joined by one space, character references are decoded.

Edge cases: null or empty html, and pages without text, give an empty string; text outside any element, unclosed and
stray tags, upper case, comments, CDATA and broken references are tolerated; after a quote that nothing closes, quotes
in tags count no more; repeated rows give repeated results; of containers that are worth the same the deepest and then
the first counts; nothing is cut. Time is in proportion to a page's length, whatever it nests or leaves open. Extra
columns are not carried.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, elements whose content is raw text, inline elements, and which
#: open elements an opening tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section table tbody td tfoot th thead tr ul".split())
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = frozenset("ul ol dl table article section div main body blockquote td th aside nav form".split())

#: Elements that never hold article text.
PRUNED = frozenset("head script style noscript template textarea title iframe object embed svg canvas form button select input nav menu footer aside dialog audio video map noembed noframes xmp".split())
#: Words in a class, id or role that tell of other things than the article.
OTHER = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|comments?|commentlist|respond|disqus|reply|replies|discussion|reader-comments|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side|footer|foot|masthead|topbar|toolbar|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|teaser|widget|pagination|pager|skip|complementary|contentinfo|search|copyright|legal|site-header|page-header|header-bar)(?:$|[\s_-])",
    re.IGNORECASE,
)
HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTES = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
#: Ancestors that a paragraph's points reach.
REACH = 5


class Node:
    __slots__ = ("tag", "parent", "children", "pruned", "order", "points", "text", "linked", "depth", "open_p")

    def __init__(self, tag: str, parent: Node | None, pruned: bool, order: int) -> None:
        self.tag, self.parent, self.pruned, self.order = tag, parent, pruned, order
        self.children: list[Node | tuple[str, bool]] = []  # blocks, and (text, inside a link)
        self.points, self.text, self.linked = 0.0, 0, 0
        self.depth = parent.depth + 1 if parent else 0
        #: The paragraph that a block opened here would end.
        self.open_p: Node | None = self if tag == "p" and parent else None if tag in SCOPE or not parent else parent.open_p


def _pruned(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in PRUNED or tag == "header" and not inside_article:
        return True
    if not attributes or attributes.isspace():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return True
        if name in ("class", "id", "role") and tag not in ("body", "html", "article", "main") and (OTHER.search(value) or HEADER.search(value) and not inside_article):
            return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", name, attributes) of each piece of markup; without a name what isn't an element, with the
    text of CDATA as attributes. A consumer may send the place to go on from."""
    pos, last, quotes = 0, page.rfind(">"), True
    while True:
        at = page.find("<", pos)
        if at < 0:
            return
        other = next((x for x in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")) if page.startswith(x[0], at)), None)
        if other:
            end = page.find(other[1], at + len(other[0]))
            text = page[at + 9 : end if end >= 0 else None] if other[1] == "]]>" else ""
            found = (at, len(page) if end < 0 else end + len(other[1]), "", "", text)
        elif at > last:
            return
        elif m := NAME.match(page, at):
            whole = ATTRIBUTES.match(page, m.end()) if quotes else None
            quotes = quotes and whole is not None
            end = whole.end() if whole else page.find(">", m.end()) + 1
            if not end:
                return
            found = (at, end, m[1], m[2].lower(), page[m.end() : end - 1])
        else:
            pos = at + 1
            continue
        pos = (yield found) or found[1]


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree of block elements, and all its nodes in page order."""
    root = Node("html", None, False, 0)
    nodes, at, links, article = [root], root, 0, 0
    opened: Counter[str] = Counter()
    inline: list[tuple[str, bool]] = []  # open inline elements that prune

    def close(top: Node) -> None:
        """Close what is open inside top, and top."""
        nonlocal at, article
        while True:
            done, at = at, at.parent
            opened[done.tag] -= 1
            article -= done.tag in ("article", "main")
            if done is top:
                return

    pos, markup, resume = 0, tags(page), None
    while True:
        try:
            start, end, closing, tag, attributes = markup.send(resume)
        except StopIteration:
            start = None
        text, resume = page[pos:start], None
        if text and not at.pruned and not inline:
            at.children.append((text, links > 0))
        if start is None:
            return root, nodes
        pos = end
        if not tag:
            if attributes and not at.pruned:
                at.children.append((attributes, links > 0))
        elif closing:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                if inline and inline[-1][0] == tag:
                    inline.pop()
            elif tag == "p":
                if at.open_p:
                    close(at.open_p)
                    inline = []
            elif opened[tag] > 0:
                top = at
                while top.tag != tag:
                    top = top.parent
                close(top)
                links, inline = 0 if tag in SCOPE else links, []
        elif tag in ("br", "hr"):
            at.children.append((" ", False))
        elif tag in VOID or tag in ("html", "body"):
            pass
        elif tag in RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, pos)
            pos = resume = (page.find(">", found.end()) + 1 if found else 0) or len(page)
        elif tag in INLINE:
            links += tag == "a"
            if inline and inline[-1][0] == tag or _pruned(tag, attributes, article > 0):
                inline.append((tag, True))
        else:
            inline = []
            if tag in ENDS_P and at.open_p:
                close(at.open_p)
            if ends := ENDS_SAME.get(tag):
                while at.parent and at.tag in ends:
                    close(at)
            at = Node(tag, at, at.pruned or _pruned(tag, attributes, article > 0), len(nodes))
            at.parent.children.append(at)
            nodes.append(at)
            opened[tag] += 1
            article += tag in ("article", "main")
            if attributes.rstrip().endswith("/") and tag in ("svg", "path", "g"):
                close(at)


def _clean(text: str) -> str:
    return SPACE.sub(" ", html.unescape(text)).strip()


def score(nodes: list[Node]) -> None:
    for node in nodes:
        if node.pruned:
            continue
        own = _clean("".join(x[0] for x in node.children if isinstance(x, tuple)))
        if own:
            node.text += len(own)
            node.linked += len(_clean("".join(x[0] for x in node.children if isinstance(x, tuple) and x[1])))
            points = 1 + own.count(",") + min(len(own) / 100, 3)
            up, d = (node if node.tag in SCOPE else node.parent) or node, 1
            while up and d <= REACH:
                up.points += points / (1 if d == 1 else 2 if d == 2 else 3 * d)
                up, d = up.parent, d + 1
    for node in reversed(nodes):
        if node.parent and not node.pruned:
            node.parent.text += node.text
            node.parent.linked += node.linked


def _density(node: Node) -> float:
    return min(1.0, node.linked / node.text) if node.text else 0.0


def main_text(page: str | None) -> str:
    """The article's text."""
    if not page:
        return ""
    root, nodes = parse(page)
    score(nodes)
    worth = {id(x): x.points * (1 - _density(x)) for x in nodes if not x.pruned}
    best = max((x for x in nodes if not x.pruned), key=lambda x: (worth[id(x)], x.depth, -x.order))
    if worth[id(best)] <= 0:
        return ""
    up = best
    while up:
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    kept = {best.order}
    if best.parent:
        for x in best.parent.children:
            if isinstance(x, Node) and x is not best and not x.pruned:
                p = x.tag == "p" and (x.text > 80 and _density(x) < 0.25 or 0 < x.text <= 80 and not x.linked)
                if p or worth[id(x)] >= max(10, 0.2 * worth[id(best)]):
                    kept.add(x.order)
    out: list[str] = []
    for order in sorted(kept):
        _blocks(nodes[order], out)
    return " ".join(out)


def _blocks(top: Node, out: list[str]) -> None:
    """The blocks' texts in page order, without recursion: trees can be deep."""
    stack: list[tuple[Node, int, list[str]]] = [(top, 0, [])]
    while stack:
        node, i, run = stack.pop()
        while i < len(node.children) and isinstance(node.children[i], tuple):
            run.append(node.children[i][0])
            i += 1
        if text := _clean("".join(run)):
            out.append(text)
        if i < len(node.children):
            stack.append((node, i + 1, []))
            if not node.children[i].pruned:
                stack.append((node.children[i], 0, []))


def _extract(key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(key), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[key, "url", "text", "n_chars"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    rows = pages.select(F.col(f"`{key}`").alias(key), F.col(f"`{url}`").alias("url"), F.col(f"`{markup}`").alias("html"))
    return rows.mapInArrow(lambda b: _extract(key, b), f"`{key}` {pages.schema[key].dataType.simpleString()}, url string, text string, n_chars bigint")
