"""Main text of web pages by composite text density.

Every node of the page's tree gets a density: its characters per tag, adjusted
by how many characters and tags are links. The densities of a node's children
are summed; the smallest density on the path from the body to the node with the
greatest sum is the page's threshold, and in each subtree that reaches it the
node with the greatest sum holds content. An article that reaches it, or that
holds the greatest sum, is content as a whole, but for blocks of links. What
cannot be content by its element or by its class or id (menus, adverts,
comments, ...) is left out first, unless it holds an article or most of the
page's text. The words of a name vote by where they stand: one that means
boilerplate at either end of a name (``user-comments``, ``ad-slot-2``) is
enough, doubtful ones (``side``, ``share``) go by the block's density against the
rest of the page, and states of a page (``has-sidebar``) say nothing.

Pages are parsed a row at a time inside ``mapInArrow``: each page is one row,
and a page's tree is gone before the next is read.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption html legend li dd dt optgroup option tbody td tfoot th thead tr".split())
LEFT_OUT = frozenset("head nav footer aside form button select dialog menu script style noscript template iframe object embed canvas svg math audio video".split())
# An element that ends an open element of the second set, up to one of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
# Words of a class, id or role that name what is not the article: alone, or first or last in a longer name.
READERS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
BOILERPLATE = READERS | frozenset(
    "ad ads adbox adslot adunit advert adverts advertisement advertising adsense sponsor sponsored sponsors promo nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification notifications "
    "subscribe subscription newsletter signup login popup modal related recommended recommendations trending pagination pager paging searchbox "
    "contentinfo complementary".split())
# Words that do so alone; in a longer name the block's density decides.
DOUBTFUL = frozenset("alert banner foot follow head header overlay promotion rail search share sharing side skip social widget widgets".split())
ALONE = BOILERPLATE | DOUBTFUL
# Words that say no more than that something is a part, a state of the page, or a part of the article.
PARTS = frozenset("area block bottom box container content inner item left list outer panel right section slot text top unit wrap wrapper".split())
STATES = frozenset("closed disabled enabled free has hide no off on open show with without".split())
OWN = frozenset("article content entry post story".split())
# Of LEFT_OUT, what holds no text of the page; the rest is left out unless it holds the article or most text.
NO_TEXT = LEFT_OUT - frozenset("nav footer aside form button dialog menu".split())
KEEPS = frozenset("article body html main".split())
# Fewer characters than this beside readers' comments are no article.
LITTLE = 50

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"<>]*+\"(?=[\s/>])|'[^'<>]*+'(?=[\s/>]))*+)>")
_HEAD = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_QUOTE = re.compile(r"=\s*+([\"'])|>")
_COMMENT_END = re.compile(r"--!?\s*>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=/>]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "children", "out", "inside", "chars", "tags", "link_chars", "link_tags", "density", "total", "kind", "holds")

    def __init__(self, name: str, parent: "Node | None", out: bool, kind: str = ""):
        self.name, self.parent, self.out, self.kind = name, parent, out, kind
        self.inside = parent is not None and (parent.inside or parent.name in ("article", "main"))
        self.children: list[Node | str] = []


@lru_cache(65_536)
def _name_kind(whole: str, inside: bool) -> str:
    """What one class, id or role says: "readers", "named", "doubtful" or ""."""
    for part in whole.split("--")[0].split("__"):
        words = [w.lower() for w in _WORDS.findall(part)]
        if not words or inside and words[-1] in ("head", "header"):
            continue  # an article has a head of its own
        if "".join(words) in ALONE or all(w in ALONE for w in words):
            return "readers" if READERS.intersection([*words, "".join(words)]) else "named"
        if STATES.intersection(words):
            continue
        while len(words) > 1 and words[-1] in PARTS:
            words.pop()
        ends = {words[0], words[-1]}
        if ends & BOILERPLATE:
            return "readers" if ends & READERS else "named"
        if ends & DOUBTFUL and words[0] not in OWN:
            return "doubtful"
    return ""


def _kind(name: str, attributes: str, parent: Node) -> str:
    """Why an element may not be content, by its name and its attributes."""
    inside = parent.inside or parent.name in ("article", "main")
    kinds = {"named"} if name in LEFT_OUT or name == "header" and not inside else set()
    if attributes and name not in ("body", "html"):
        if _HIDDEN.search(attributes):
            kinds.add("named")
        for m in _NAMES.finditer(attributes):
            for whole in (m[1] or m[2] or m[3] or "").split():
                if name not in KEEPS or "".join(w.lower() for w in _WORDS.findall(whole)) in BOILERPLATE:
                    kinds.add(_name_kind(whole, inside))
    return next((k for k in ("readers", "named", "doubtful") if k in kinds), "")


def _leave_out(root: Node) -> None:
    """Boilerplate goes, unless it holds an article or main element that is none
    itself, or most of the page's characters outside links (which says nothing
    of an element outside the page's article: a footer may be longer). Readers'
    comments may be longer than the article as well: they stay only where
    nothing else is there. Doubtful names go where the block has fewer
    characters a tag than the rest of the page, or is mostly links."""
    nodes = _post_order(root)
    for n in nodes:
        inner = [c for c in n.children if not isinstance(c, str) and not c.out]
        own = sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        n.link_chars = sum(c.link_chars for c in inner)
        n.chars = own + sum(c.chars for c in inner)
        if n.name == "a":
            n.chars, n.link_chars = 0, n.link_chars + n.chars
        n.tags = 1 + sum(c.tags for c in inner)
        n.holds = any(c.holds or c.name in ("article", "main") and not c.kind for c in inner)
    for n in nodes:
        if not n.kind or n.name in KEEPS or n.holds:
            continue
        rest = root.chars - n.chars
        most = n.chars > rest and (not root.holds or n.inside)
        if n.kind == "readers":
            n.out = not (most and rest < LITTLE)
        elif n.kind == "named":
            n.out = not most
        else:
            thin = n.chars * max(root.tags - n.tags, 1) < rest * n.tags
            n.out = not most and (thin or n.link_chars > n.chars)


def _tag_end(page: str, at: int, last: int, open_quotes: set[str]) -> int:
    """Where the tag whose attributes begin at ``at`` ends. A quote that is never
    closed, or whose other end stands inside another tag, is a character as any
    other. ``last`` is the page's last ">"; quotes that are not closed before it
    are kept in ``open_quotes`` and not looked for again."""
    while True:
        m = _QUOTE.search(page, at)
        if not m[1]:
            return m.start()
        at = m.end()
        if m[1] in open_quotes:
            continue
        close = page.find(m[1], at, last)
        if close < 0:
            open_quotes.add(m[1])
        elif page.find(">", at, close) < 0 or page[close + 1] in "/>" or page[close + 1].isspace():
            at = close + 1


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("", "", text), ("", name, attributes) for start tags and ("/", name, "")
    for end tags; comments and declarations are skipped, and so is what stands
    in raw elements. One pass: no character is looked at more often than a
    fixed number of times."""
    at, text, size, last = 0, 0, len(page), page.rfind(">")
    open_quotes: set[str] = set()
    while True:
        at = page.find("<", at)
        if at >= 0 and page.startswith("<!--", at):
            end = _COMMENT_END.search(page, at + 2)
            stop, token = end.end() if end else size, None
        elif at < 0 or at > last:
            break
        elif m := _TAG.match(page, at):
            stop, token = m.end(), (m[1], m[2].lower(), m[3])
        elif m := _HEAD.match(page, at):
            end = _tag_end(page, m.end(), last, open_quotes)
            stop, token = end + 1, (m[1], m[2].lower(), page[m.end() : end])
        elif page[at + 1] in "!?/":
            stop, token = page.find(">", at) + 1, None
        else:
            at += 1
            continue
        if at > text:
            yield "", "", page[text:at]
        if token is not None:
            yield token
            if not token[0] and token[1] in RAW:
                end = _RAW_END[token[1]].search(page, stop)
                stop = end.end() if end else size
        at = text = stop
    if text < size:
        yield "", "", page[text:]


def parse(page: str) -> Node:
    """The page as a tree; missing end tags are implied as browsers do for
    paragraphs, list items, cells and options, and stray end tags are dropped.

    The depths of the open elements are kept by name, so that what an end tag
    closes is found without walking up the tree."""
    root = Node("html", None, False)
    path = [root]
    depths: dict[str, list[int]] = {}
    walls: list[int] = []  # open tables and articles
    boxes: list[int] = []  # open block elements but paragraphs

    def close(depth: int) -> None:
        while len(path) > depth:
            name = path.pop().name
            depths[name].pop()
            for stack in (walls, boxes):
                if stack and stack[-1] == len(path):
                    stack.pop()

    def deepest(name: str) -> int:
        found = depths.get(name)
        return found[-1] if found else 0

    for slash, name, attributes in _tokens(page):
        if not name:
            path[-1].children.append(attributes)
            continue
        if slash:
            depth = deepest(name)
            if depth and (name in BLOCK or not walls or walls[-1] < depth):
                close(depth)
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_P or name in ("li", "dd", "dt"):
            depth = deepest("p")
            if depth and (not boxes or boxes[-1] < depth):
                close(depth)
        if name in ENDS:
            ended, within = ENDS[name]
            floor = max(map(deepest, within))
            first = [d[k] for d in map(depths.get, ended) if d and (k := bisect_right(d, floor)) < len(d)]
            if first:
                close(min(first))
        parent = path[-1]
        new = Node(name, parent, parent.out or name in NO_TEXT or name in RAW, _kind(name, attributes, parent))
        parent.children.append(new)
        if name in VOID or name in RAW or attributes.endswith("/") and name not in BLOCK:
            continue
        depths.setdefault(name, []).append(len(path))
        if name in ("table", "article"):
            walls.append(len(path))
        if name in BLOCK and name != "p":
            boxes.append(len(path))
        path.append(new)
    _leave_out(root)
    return root


def _post_order(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(c for c in n.children if not isinstance(c, str) and not c.out)
    return order[::-1]


def measure(root: Node) -> list[Node]:
    """Counts, densities and sums of child densities, from the leaves up."""
    nodes = _post_order(root)
    for n in nodes:
        n.chars = sum((0 if c.isspace() else len(c)) if isinstance(c, str) else 0 if c.out else c.chars for c in n.children)
        inner = [c for c in n.children if not isinstance(c, str) and not c.out]
        n.tags = sum(c.tags + 1 for c in inner)
        n.link_tags = sum(c.link_tags + (c.name == "a") for c in inner)
        n.link_chars = n.chars if n.name == "a" else sum(c.link_chars for c in inner)
    body = max(root.chars, 1)
    share = root.link_chars / body
    for n in nodes:
        c, lc, t, lt = n.chars, n.link_chars, max(n.tags, 1), max(n.link_tags, 1)
        if not c:
            n.density = 0.0
        else:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            n.density = c / t * (math.log(c / max(lc, 1) * t / lt) / math.log(base) if base > 1.0001 else 1.0)
            n.density = max(n.density, 0.0)
        n.total = sum(k.density for k in n.children if not isinstance(k, str) and not k.out)
        if any(isinstance(k, str) and not k.isspace() for k in n.children):
            n.total = max(n.total, n.density)  # its own text is content as well
    return nodes


def content(root: Node) -> list[Node]:
    """The nodes that hold the main text, in page order. The threshold selects
    over the whole tree; an article that reaches it is taken as a whole, and so
    is the innermost article or main element around the greatest sum. Blocks
    of links in them that do not reach the threshold are left out."""
    nodes = measure(root)
    if not root.chars:
        return []
    best: dict[int, Node] = {}
    for n in nodes:
        top = n
        for c in n.children:
            if not isinstance(c, str) and not c.out and best[id(c)].total > top.total:
                top = best[id(c)]
        best[id(n)] = top
    peak = best[id(root)]
    threshold, up, named = math.inf, peak, None
    while up is not None:
        threshold = min(threshold, up.density)
        named = named or (up if up.name in ("article", "main") else None)
        up = up.parent
    marked, stack = [], [root]
    while stack:
        n = stack.pop()
        if n is named or n.density >= threshold and (n.name == "article" or best[id(n)] is n):
            if n.chars:
                marked.append(n)  # with all that lies below
        else:
            stack.extend(c for c in reversed(n.children) if not isinstance(c, str) and not c.out)
    stack = list(marked)
    while stack:
        for c in stack.pop().children:
            if not isinstance(c, str) and not c.out:
                c.out = c.name in BLOCK and c.link_tags > 1 and 2 * c.link_chars > c.chars and c.density < threshold
                stack.append(c)
    return marked


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order: references decoded,
    white space folded, empty blocks left out."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    stack: list[tuple[Node | str, bool]] = [(node, False)]
    while stack:
        n, done = stack.pop()
        if isinstance(n, str):
            run.append(n)
        elif n.out:
            continue
        elif done:
            flush()
        else:
            if n.name == "br":
                run.append(" ")
            if n.name in BLOCK or n is node:
                flush()
                stack.append((n, True))
            stack.extend((c, False) for c in reversed(n.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(t for n in content(parse(page)) for t in blocks(n)) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "html"):
        texts = [main_text(p) for p in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    text joins the blocks of the main content by one line feed. Null and empty
    pages and pages without content have an empty text. Ids and urls are
    carried as they are, nulls included; repeated rows give repeated results.
    Where nodes tie, the outer one and then the earlier one holds the content.
    Other columns are not read. An empty table gives no rows.
    """
    src = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
