"""Main text of web pages by tree scoring.

A page is parsed into a tree that closes elements as browsers do. Every block of text passes points for its length and
commas to its ancestors, halved at each step, and an element's points are discounted by its link density. The best
container is kept, or the article or main element around it, and those of its siblings that read like text as well.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are never kept: by
element, by role, or by class and id. A class says so where it is one of NOISE (class="related") or made of such and of words
for boxes (related-posts, ad-container), not where other words give it another sense (market-share, related-work); of
paragraphs, headings, quotations and cells only whole words count. Of a header inside an article its headings are kept, no
more. A list is left out as a menu where it is of links and its items are short. What is left comes out block by block.

A null or empty page, or one without text, gives an empty string. Cut-off pages, unclosed elements and stray end tags
are read as far as they go, as browsers do, but for a quoted value that never ends: its tag ends at the next >. Time and
memory are in proportion to a page, however deep it is. Long pages are read whole. Repeated rows stay; columns named text or
n_chars are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import batched, raw_texts, small_batches

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split())
#: Not a border within a block: cells of a row stand side by side.
CELLS = frozenset(("td", "th"))
DROPPED = frozenset("head nav header footer aside form button select datalist dialog menu object audio video canvas script style template svg math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section article main body".split())
#: Elements of text, that compound classes do not condemn.
PLAIN = HEADINGS | frozenset("p blockquote pre td th dt dd figcaption caption".split())
#: Drawings and formulas: a tag of HTML within them ends them, as in browsers, unless it is inside one of PORTALS.
FOREIGN, PORTALS = frozenset(("svg", "math")), frozenset("foreignobject desc annotation-xml".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article section main header footer nav aside".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id, split at marks and case, that name what is no part of an article.
NOISE = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside nav navbar navigation menu breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist reply replies disqus respond pager pagination skip toolbar widget widgets copyright".split())
TEXTUAL = frozenset("article main content body post story entry text".split())
#: Words before one of NOISE that say something about the page instead, words of frames, and noise that no frame excuses.
ABOUT = frozenset("has with no without is".split())
LAYOUT = frozenset("wrap wrapper container layout page site grid".split())
#: Words for boxes, which leave a word of NOISE its sense.
NEUTRAL = LAYOUT | TEXTUAL | frozenset("box block area section list item items bar panel inner outer left right top bottom center middle primary secondary global button buttons btn link links icon icons unit slot space zone row col column columns group holder region module message title form input field posts articles stories more media image img google leaderboard rectangle sticky fixed floating inline small large mini mobile desktop".split())
HARD = frozenset("comment comments reply replies ad ads advert related promo cookie".split())
#: What a start tag ends, by the kind of the nearest such element in its scope; the outermost of those open goes.
CLOSES = {"li": ("li",), "dt": ("dt",), "dd": ("dt",), "tr": ("tr", "td"), "td": ("td",), "th": ("td",), "option": ("option",), "thead": ("tbody", "tr", "td"), "tbody": ("tbody", "tr", "td"), "tfoot": ("tbody", "tr", "td")}
KIND = {"p": "p", "li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "thead": "tbody", "tbody": "tbody", "tfoot": "tbody", "option": "option"}
#: Elements that start a new scope, and of which kinds. A table starts one of all.
SCOPES = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dt",), "select": ("option",), "datalist": ("option",), "button": ("p",), "table": tuple(sorted(set(KIND.values())))}
NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
MIN_CHARS, SIBLING = 25, 0.2
#: Items of a menu have fewer characters than this on average.
MENU_ITEM = 30


class Node:
    __slots__ = ("parent", "tag", "dropped", "rescue", "bonus", "own", "points", "chars", "linked", "blocks", "depth", "article", "foreign", "open")

    def __init__(self, parent: Node | None, tag: str, dropped: bool, bonus: float):
        self.parent, self.tag, self.dropped, self.bonus = parent, tag, dropped, bonus
        self.own = self.points = 0.0
        self.chars = self.linked = self.blocks = 0
        self.depth = parent.depth + 1 if parent else 0
        self.article = self if tag in ("article", "main") and not dropped else parent.article if parent else None
        #: Whether headings in here are kept although this is not.
        self.rescue = bool(parent and (parent.rescue or tag == "header" and parent.article and not parent.dropped))
        self.foreign = self if tag in FOREIGN else None if tag in PORTALS else parent.foreign if parent else None
        #: The nearest open element of each kind that a start tag may end.
        self.open: dict[str, Node] = parent.open if parent else {}
        if tag in SCOPES and self.open:
            self.open = {k: v for k, v in self.open.items() if k not in SCOPES[tag]}
        if tag in KIND:
            self.open = self.open | {KIND[tag]: self}


def _noisy(tag: str, token: str) -> bool:
    """Whether a class or id says that its element is no part of an article."""
    words = [x.lower() for x in PIECE.findall(token) if len(x) > 1]
    noise = {w for before, w in zip(["", *words], words, strict=False) if w in NOISE and before not in ABOUT}
    if not noise:
        return False
    textual = not TEXTUAL.isdisjoint(words)
    if noise <= {"header", "masthead"} and textual or (tag in ("article", "main") or textual and not LAYOUT.isdisjoint(words)) and noise.isdisjoint(HARD):
        return False
    return len(words) == 1 or tag not in PLAIN and (NOISE | NEUTRAL).issuperset(words)


def _traits(tag: str, attributes: str) -> tuple[bool, float]:
    """Whether an element is no part of an article, and its points to begin with."""
    dropped, bonus = tag in DROPPED, 25.0 if tag in ("article", "main") else 0.0
    if attributes:
        for name, *values in NAMES.findall(attributes):
            value, name = "".join(values), name.lower()
            if name == "role":
                dropped |= value.lower() in ROLES
                bonus += 25 * (value.lower() in ("main", "article"))
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                dropped = True
            elif name == "style":
                dropped |= "display:none" in value.replace(" ", "").lower()
            elif tag not in ("html", "body"):
                dropped |= any(_noisy(tag, token) for token in value.split())
                bonus += 10 * (not TEXTUAL.isdisjoint(x.lower() for x in PIECE.findall(value)))
    return dropped, bonus


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """The elements of a page, parents first, and its blocks: innermost element, text, and how many of its characters are in
    links."""
    at, root = 0, Node(None, "#", False, 0)
    node, links = root, 0
    nodes, standing = [root], Counter()
    blocks: list[tuple[Node, str, int]] = []
    held: list[str] = []
    linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not node.dropped:
            held.append(unescape(piece) if "&" in piece else piece)
            if links:
                linked += len(held[-1])

    def border() -> None:
        nonlocal linked
        if held:
            if whole := " ".join("".join(held).split()):
                blocks.append((node, whole, min(linked, len(whole))))
            held.clear()
            linked = 0

    def close(upto: Node) -> None:
        nonlocal node, links
        while node is not upto.parent:
            links -= node.tag == "a"
            standing[node.tag] -= 1
            node = node.parent

    size = len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            text(html[at:])
            break
        found = TOKEN.match(html, start)
        if not found:
            text(html[at : start + 1])
            at = start + 1
            continue
        text(html[at:start])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if tag in BLOCK:
                border() if tag not in CELLS else held.append(" ")
            elif tag == "br":
                held.append(" ")
            if standing[tag] > 0:
                over = node
                # An inline end tag does not close blocks around it.
                while over.tag != tag and (over.tag not in BLOCK or tag in BLOCK or tag in DROPPED):
                    over = over.parent
                if over.tag == tag:
                    close(over)
            continue
        if node.foreign and tag in BREAKOUT:
            close(node.foreign)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag in VOID:
            if tag == "br":
                held.append(" ")
            elif tag == "hr":
                border()
            continue
        if tag in BLOCK:
            border() if tag not in CELLS else held.append(" ")
            ends = [node.open[k] for k in (*CLOSES.get(tag, ()), *(() if tag in CELLS else ("p",))) if k in node.open]
            if ends:
                close(min(ends, key=lambda n: n.depth))
        if found[3].endswith("/") and (node.foreign or tag in FOREIGN or tag not in BLOCK and tag not in DROPPED and tag != "a"):
            continue
        dropped, bonus = _traits(tag, found[3])
        saved = tag in HEADINGS and node.rescue
        node = Node(node, tag, dropped or node.dropped and not saved, bonus)
        nodes.append(node)
        standing[tag] += 1
        links += tag == "a"
    border()
    return nodes, blocks


def _owner(node: Node) -> Node:
    while node.tag not in BLOCK and node.parent is not None:
        node = node.parent
    return node


def _value(n: Node) -> float:
    return (n.points + n.bonus) * (1 - n.linked / n.chars) if n.chars else 0.0


def main_text(html: str) -> str:
    nodes, found = parse(html)
    blocks = [(_owner(node), whole, linked) for node, whole, linked in found]
    if not blocks:
        return ""
    for node, whole, linked in blocks:
        if len(whole) >= MIN_CHARS:
            node.own += 1 + whole.count(",") + whole.count("،") + whole.count("、") + min(len(whole) / 100, 3)
        node.chars += len(whole)
        node.linked += linked
        node.blocks += 1
    # Every element passes up, once, half of what its children passed, and its own points: whole, or half if it takes them itself.
    scored = []
    for node in reversed(nodes):
        above, passed = node.parent, node.points / 2
        if node.tag in CONTAINERS:
            node.points += node.own
            passed += node.own / 2
        else:
            passed += node.own
        if node.chars:
            scored.append(node)
        if above is not None:
            above.points += passed
            above.chars += node.chars
            above.linked += node.linked
            above.blocks += node.blocks
    scored = [n for n in scored if n.points or n.tag in CONTAINERS or n.parent is None]
    best = max(scored, key=lambda n: (_value(n), -n.depth))
    kept = {best.article or best}
    if not best.article and best.parent is not None:
        least = max(10, SIBLING * _value(best))
        for node in nodes:
            if node.parent is best.parent and node.chars and (_value(node) >= least or node.tag in ("p", "h1", "h2", "h3", "blockquote", "pre") and node.linked / node.chars < 0.25):
                kept.add(node)
    elif best.article:
        # Text may be spread over several articles or main elements of about the same weight.
        kept |= {n for n in scored if n.article is n and _value(n) >= max(10, SIBLING * _value(best.article)) and n.parent is best.article.parent}
    inside: set[Node] = set()
    for node in nodes:
        menu = node.tag in ("ul", "ol") and node.linked > 0.75 * node.chars and node.chars < MENU_ITEM * node.blocks
        if node in kept or node.parent in inside and not menu:
            inside.add(node)
    return "\n\n".join(whole for node, whole, _ in blocks if node in inside)


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """pages, without the html, with text and n_chars (code points)."""
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, html_col):
            texts = [main_text(x.decode()) for x in raw_texts(batch, html_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*kept, "text", "n_chars"])

    schema = T.StructType([*pages.select(*kept).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*kept, F.col(html_col)).mapInArrow(run, schema)


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
