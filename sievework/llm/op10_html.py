"""Operator 10, main text of web pages by composite text density.

A page is parsed into a tree of elements (a tolerant single pass: raw-text elements, void elements, implied ends).
Parts that name themselves as no article (menus, headers and footers of the page, side bars, notices, adverts,
forms, reader comments; by element, role, class or id) are left out. For every other node, with C characters, T
elements below it, and LC and LT of these in links, the composite density is

    C/T * log_b(C/LC * T/LT),  b = ln(C*LC/nLC + C*LCb/Cb + e),

with nLC = C - LC and LCb, Cb the body's, zero counts taken as one. The subtree with the greatest sum of its
children's densities is the article's core. The least density on the path from there to the body is the threshold: what
stands beside that path and reaches it belongs to the article too, and so do headings and blocks without links beside
the core, in the part of the path that is mostly such text.

A part that names itself as no article by a class or id alone is left out unless it holds <main>, or a quarter of the
page's text that isn't in links with the page's h1, or half of it while no h1, main or article stands elsewhere (wrappers carry
such words too: "has-sidebar"). Inside an article, words that articles use for their own sections ("discussion") mark a
part only if it has neither a heading nor `PROSE` characters of text outside links; words of adverts, notices and share bars mark it
unless it holds `ADVERT_PROSE` such characters in two blocks or more. Headings are never such parts.

The core and what belongs to it shed lists of links: blocks of three links or more, mostly in links and less dense than
the threshold.

Map-only. Defined results: a null or empty page has an empty text; without markup the whole text is one block;
pages of any length are parsed whole; only script, style, iframe, textarea and title without an end take the rest of the page; ties of density go to the node further up; repeated rows are extracted each
for itself; an empty table gives no rows; other columns are neither read nor passed on; page_id and url may be null.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

# Element names of the HTML standard by their role in parsing and layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title".split())
#: Left out with what they hold, if they end by their own tag or hold no blocks: without that tag they would take the page with them.
INSET = frozenset("noscript template svg canvas object select button annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav aside footer form menu dialog head fieldset".split()) | RAW
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("ul ol dl table body html article section div main td".split()) | INSET
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Words in a class or an id that mark a part as no article.
HINTS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription"
    " sidebar side rail menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer foot bottombar comment comments commentlist respond reply replies disqus discussion share sharing social"
    " related recommended recommendations widget widgets login signup search toolbar pagination pager".split()
)
#: Those of them that headings and sections inside an article have too.
COMMON = frozenset(
    "header discussion related recommended recommendations search notice notices side alert banner navigation menu menus promotion advertising advertisement sponsor sponsored subscription consent reply replies"
    " cookie cookies login signup share sharing social widget widgets comment".split()
)
#: Those of COMMON that name adverts, notices and share bars: inside an article they need more text to be taken for a section of it.
BESIDE = frozenset("banner promotion advertising advertisement sponsor sponsored subscription consent cookie cookies login signup share sharing social widget widgets alert notice notices".split())
PROSE, ADVERT_PROSE = 200, 400
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ANCHORS = HEADINGS | {"article", "main"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
MARKS = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SCHEMA = "page_id long, url string, text string, n_chars long"


class Node:
    __slots__ = ("tag", "parent", "kids", "chars", "tags", "link_chars", "link_tags", "dropped", "named", "hinted", "soft", "holds", "blocks", "n_blocks", "density")

    def __init__(self, tag: str, parent: Node | None, mark: str = ""):
        self.tag, self.parent = tag, parent
        self.dropped, self.named, self.hinted = mark == "part" or tag in INSET, mark == "part", mark == "hint"
        self.soft = mark if mark in ("topic", "beside") else ""
        self.holds: dict[str, int] = {}  # how many article, main and heading elements lie below
        self.n_blocks = 0  # block elements with text of their own outside links
        self.blocks = False  # whether a block element lies below
        self.kids: list = []  # nodes and strings in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0
        if parent is not None:
            parent.kids.append(self)
            up = parent
            while tag in BLOCK and up is not None and not up.blocks:
                up.blocks, up = True, up.parent
            up = parent
            while tag in ANCHORS and up is not None:
                up.holds[tag] = up.holds.get(tag, 0) + 1
                up = up.parent


def within(at: Node | None) -> bool:
    """Whether the place below a node is inside an article."""
    while at is not None and at.tag not in ("article", "main"):
        at = at.parent
    return at is not None


def mark_of(tag: str, attributes: str, parent: Node) -> str:
    """What an element says of itself: "part" beside the article, "hint" (by class or id alone), or nothing."""
    if tag in DROPPED or tag == "header" and not within(parent):
        return "part"
    if not attributes or tag in ("html", "body", "article", "main"):
        return ""
    hint = ""
    for m in MARKS.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and m[2] is None and m[3] is None or name == "aria-hidden" and value == "true":
            return "part"
        if name == "role" and value.lower() in ROLES or name == "style" and "display:none" in value.replace(" ", "").lower():
            return "part"
        if name in ("class", "id") and tag not in HEADINGS and (hints := hints_in(value)):
            if not hints <= COMMON or not within(parent):
                hint = "hint"
            elif hint != "hint":
                hint = "beside" if hints & BESIDE or hint == "beside" else "topic"
    return hint


def hints_in(value: str) -> set[str]:
    """The hints among a class's or id's words; "side" only by itself or with a word for a column, as in "left-side"."""
    out: set[str] = set()
    for name in value.split():
        words = {w.lower() for w in WORDS.findall(name)}
        hints = HINTS & words
        if "side" in hints and words - {"side", "left", "right", "col", "column", "content", "box", "panel", "block", "area", "bar"}:
            hints -= {"side"}
        out |= hints
    return out


def leave(at: Node | None, to: Node | None) -> None:
    """Nodes from at up to `to` end without their own tags: an inset one that holds blocks never was one."""
    while at is not None and at is not to:
        if at.tag in INSET and at.blocks:
            at.dropped = at.named
        at = at.parent


def parse(page: str) -> Node:
    """The page's tree."""
    root = Node("html", None)
    at, pos, n = root, 0, len(page)
    while pos < n:
        m = TOKEN.search(page, pos)
        stop = m.start() if m else n
        if stop > pos:
            at.kids.append(entities.unescape(page[pos:stop]))
        if m is None:
            break
        pos = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                at.kids.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            up = at
            while up is not None and up.tag != tag:
                up = None if up.tag in ("td", "th") and tag not in BLOCK else up.parent
            if up is not None and up.parent is not None:
                leave(at, up)
                at = up.parent
            continue
        if tag in ("html", "body") and at.tag in ("html", "body", "head"):
            leave(at, root)
            at = root
            if tag == "body":
                at = Node("body", root)
            continue
        if tag in BLOCK:
            up = at
            ends = IMPLIED_END.get(tag)
            while up is not None and up.tag not in FENCE and up.tag != "p" and not (ends and up.tag in ends):
                up = up.parent
            if up is not None and (up.tag == "p" or ends and up.tag in ends) and up.parent is not None:
                leave(at, up)
                at = up.parent
        node = Node(tag, at, mark_of(tag, m[3], at))
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        at = node
    leave(at, None)
    return root


def measure(root: Node) -> list[Node]:
    """Fills the counts of every kept node, children first; returns the kept nodes, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in reversed(node.kids) if isinstance(k, Node) and not k.dropped]
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = node.n_blocks = 0
        for k in node.kids:
            if isinstance(k, str):
                node.chars += sum(map(len, k.split()))
            elif not k.dropped:
                node.n_blocks += k.n_blocks + (k.tag in BLOCK and not k.n_blocks and k.chars > k.link_chars)
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
    return order


def drop_hinted(order: list[Node], body: Node) -> bool:
    """Drops the parts named by class or id alone, but wrappers of the article and its own sections; whether there are any."""
    plain = lambda node: node.chars - node.link_chars
    total = plain(body)
    hinted = [n for n in order if n.hinted]
    kept = {id(n) for n in hinted if n.holds.get("main") or n.holds.get("h1") and 4 * plain(n) >= total}
    # Anchors of an article outside all hinted parts, or in those that are kept.
    clear, anchors = {id(body)}, 0
    for node in order:
        if node is body or id(node.parent) in clear and (not node.hinted or id(node) in kept):
            clear.add(id(node))
            anchors += node.tag in ("h1", "main", "article")
    for n in hinted:
        own = n.holds.get("h1") or n.holds.get("article") == 1
        if 2 * plain(n) >= total and (own or not anchors):
            kept.add(id(n))
    found = False
    for n in order:
        if n.hinted and id(n) not in kept:
            n.dropped = found = True
        elif n.soft == "topic" and not HEADINGS & n.holds.keys() and plain(n) < PROSE:
            n.dropped = found = True
        elif n.soft == "beside" and (plain(n) < ADVERT_PROSE or n.n_blocks < 2):
            n.dropped = found = True
    return found


def densities(order: list[Node], body: Node) -> None:
    share = body.link_chars / max(1, body.chars)
    for node in order:
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if not c:
            continue
        base = math.log(c * lc / max(1, c - node.link_chars) + share * c + math.e)
        inside = c / lc * t / lt
        node.density = c / t * (math.log(inside) / math.log(base) if inside > 1 and base > 1 else 0.0)


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, white space made single blanks."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    stack: list = [node]
    while stack:
        k = stack.pop()
        if k is None:
            end()
        elif isinstance(k, str):
            line.append(k)
        elif not k.dropped:
            if k.tag == "br":
                line.append(" ")
            if k.tag in BLOCK:
                end()
                stack.append(None)
            stack += reversed(k.kids)
    end()
    return out


def path_of(node: Node, body: Node) -> list[Node]:
    """The node and those above it, below the body."""
    path = []
    while node is not body:
        path.append(node)
        node = node.parent
    return path


def core_of(order: list[Node], body: Node) -> tuple[Node, float]:
    """The block with the greatest sum of its children's densities (of equals the one further up), and the least density on its path."""
    below = {id(body)}
    best, most = body, -1.0
    for node in order:  # parents first
        if node is not body and (node.parent is None or id(node.parent) not in below):
            continue
        below.add(id(node))
        total = sum(k.density for k in node.kids if isinstance(k, Node) and not k.dropped)
        if total > most and node.tag != "a":
            best, most = node, total
    while best is not body and best.tag not in BLOCK:  # an inline element: its block
        best = best.parent
    return best, min([n.density for n in path_of(best, body)] + [body.density])


def shed(order: list[Node], core: Node, threshold: float) -> bool:
    """Drops lists of links, wherever they stand below the core's block or beside it; False, and drops nothing, if no other text would be left."""
    lists = [n for n in order if n.tag in BLOCK and n is not core and n.link_tags >= 3 and 2 * n.link_chars >= n.chars and n.density < threshold]
    inside = {id(core)}
    for node in order:
        if node.parent is not None and id(node.parent) in inside:
            inside.add(id(node))
    lists = [n for n in lists if id(n) in inside]
    if sum(n.chars for n in lists if id(n.parent) == id(core)) >= core.chars:
        return False
    for n in lists:
        n.dropped = True
    return True


def extract(page: str | None) -> str:
    """The article's text: a line a block."""
    if not page:
        return ""
    root = parse(page)
    order = measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    if drop_hinted(order, body):
        order = measure(root)
    densities(order, body)
    best, threshold = core_of(order, body)
    path = path_of(best, body)
    parts = {id(best)}
    for at in path:
        for k in at.parent.kids:
            if isinstance(k, Node) and not k.dropped and k is not at and k.chars and 2 * k.link_chars < k.chars:
                plain = not k.link_tags and (k.tag in HEADINGS or k.tag in BLOCK and at.parent is not body)
                if k.density >= threshold > 0 or plain or k.tag == at.tag in ("article", "main"):
                    parts.add(id(k))
        if at.parent is not body and at.tag not in ("article", "main"):
            # Text between the blocks beside the path belongs to its parent: the parent as a whole, if nothing in it is left out.
            if all(not isinstance(k, str) and (k.dropped or not k.chars or k is at or id(k) in parts) or isinstance(k, str) for k in at.parent.kids):
                parts.add(id(at.parent))
    if not shed(order, best, threshold):
        return "\n".join(blocks(body))  # nothing but lists of links
    if best is body:
        return "\n".join(blocks(body))
    out: list[str] = []
    taken: set[int] = set()  # nodes below a part that has been written
    for node in order:
        if node.parent is not None and id(node.parent) in taken:
            taken.add(id(node))
        elif id(node) in parts:
            taken.add(id(node))
            out += blocks(node)
    return "\n".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
