"""Main text: pages as browsers read them, time by size, and a plain scorer on the whole table."""

import time
from html.parser import HTMLParser

import pytest

from quern.llm import html

LONG = "A paragraph with words, long enough to be scored, surely so."
MORE = "And another one that follows, long enough as well, surely."

PAGES = {
    f'<article><p>{LONG}</p><svg class="i"/><p>{MORE}</p></article>': f"{LONG}\n\n{MORE}",
    f"<article><p>{LONG}</p><svg><title>icon</title><text>drawn</text><svg><g/></svg><text>t</text></svg><p>{MORE}</p></article>": f"{LONG}\n\n{MORE}",
    f"<article><p>{LONG}</p><svg><path><p>{MORE}</p></article>": f"{LONG}\n\n{MORE}",
    f"<article><p>{LONG}</p><!--><p>{MORE}</p><!---><p>x</p><!-- a --!><p>y</p></article>": f"{LONG}\n\n{MORE}\n\nx\n\ny",
    f"<article><p>{LONG}</p><img alt=it's src=x.png><p>{MORE}</p></article>": f"{LONG}\n\n{MORE}",
    f'<article><p class="a>{LONG}</p><p>{MORE}</p></article>': f"{LONG}\n\n{MORE}",
    f"<article><p title='a > b' class=x>{LONG}</p><p data-x=a'b\"c>{MORE}</p></article>": f"{LONG}\n\n{MORE}",
    f"<article><p>{LONG}</p><template><p>one</p><template><p>two</p></template><p>three</p></template><p>{MORE}</p></article>": f"{LONG}\n\n{MORE}",
    f"<article><header><h1>Headline</h1><p>By somebody, on some day of the year</p></header><p>{LONG}</p></article>": f"Headline\n\n{LONG}",
    f"<header><h1>The site</h1></header><article><p>{LONG}</p></article><header><h2>no</h2></header>": LONG,
    f"<article><p>{LONG}</p><ul><li><a href=x>Somebody: a book about things, first volume, 1999</a><li><a href=y>Another: more about such things, second volume</a></ul></article>": f"{LONG}\n\nSomebody: a book about things, first volume, 1999\n\nAnother: more about such things, second volume",
    f"<article><ul><li><a href=x>One</a><li><a href=y>Two</a></ul><p>{LONG}</p></article>": LONG,
    f"<article><div class='related-posts'><p>{MORE}</p></div><div class='share buttons'>Share this</div><p class='notice'>We use cookies</p><p>{LONG}</p><div id=comments><p>{MORE}</p></div></article>": LONG,
    f"<div><div><ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>{LONG}<table><tr><td>x<td>y<tr><td>z</table><p>{MORE}</div></div>": f"a\n\nb\n\nc\n\nd\n\n{LONG}\n\nx y\n\nz\n\n{MORE}",
    f"<article><dl><dt>t<dd>{LONG}<dt>u<dd>v</dl></b></section><p>w</article>": f"t\n\n{LONG}\n\nu\n\nv\n\nw",
} | {f"<article><p>{LONG}</p><div class='{name}'><p>{MORE}</p></div></article>": f"{LONG}\n\n{MORE}" for name in ("table-widget", "market-share", "related-work", "notice-period", "ad-hoc", "article-header", "no-sidebar")}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert html.main_text(page) == PAGES[page]


DEEP = {
    "divs": "<div>" * 50_000 + LONG,
    "texts": "".join(f"<div>{i} {LONG}" for i in range(8_000)),
    "table": "<p><table><td>" + "<div>" * 50_000 + LONG,
    "stray": "<div>" * 20_000 + "</section></b></p>" * 20_000 + LONG,
    "lists": "<ul><li>" * 15_000 + LONG,
    "bold": "<b>" * 20_000 + f"<p>{LONG}</p>" * 3 + "</i>" * 20_000,
    "quotes": "<a b='<" * 30_000 + f"><p>{LONG}",
}


@pytest.mark.parametrize("name", DEEP)
def test_time_by_size(name):
    began = time.process_time()
    html.main_text(DEEP[name])
    assert time.process_time() - began < 1.5


class Plain(HTMLParser):
    """A tree by the standard library's tokenizer; scores by walking up from each block."""

    def __init__(self, page):
        super().__init__()
        self.root = self.at = {"tag": "#", "up": None, "off": False, "raw": False}
        self.blocks, self.text, self.linked = [], "", 0
        self.feed(page)
        self.close()
        self.flush()

    def chain(self, node):
        while node:
            yield node
            node = node["up"]

    def flush(self):
        if text := " ".join(self.text.split()):
            self.blocks.append((next((n for n in self.chain(self.at) if n["tag"] in html.BLOCK), self.root), text, min(self.linked, len(text))))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag in html.VOID:
            self.text += " " if tag == "br" else ""
            return
        if tag in html.BLOCK:
            self.flush()
            for n in self.chain(self.at):
                if n["tag"] == "p":
                    self.at = n["up"]
                    break
        off = self.at["off"] or tag in ("nav", "footer", "header", "aside", "form", "head", "script", "style", "title") or any(v in ("ad", "sidebar", "comments", "notice") for k, v in attrs if k in ("class", "id"))
        self.at = {"tag": tag, "up": self.at, "off": off}

    def handle_endtag(self, tag):
        if tag in html.BLOCK:
            self.flush()
        for n in self.chain(self.at):
            if n["tag"] == tag:
                self.at = n["up"]
                return
            if n["tag"] in html.BLOCK and tag not in html.BLOCK:
                return

    def handle_data(self, data):
        if not self.at["off"]:
            self.text += data
            self.linked += len(data) * any(n["tag"] == "a" for n in self.chain(self.at))

    def best(self):
        points, chars, linked, nodes = {}, {}, {}, {}
        for node, text, link in self.blocks:
            worth, share = (1 + text.count(",") + text.count("،") + text.count("、") + min(len(text) / 100, 3)) * (len(text) >= 25), 1.0
            for n in self.chain(node):
                k = id(n)
                nodes[k] = n
                chars[k], linked[k] = chars.get(k, 0) + len(text), linked.get(k, 0) + link
                if n is not node or n["tag"] in html.CONTAINERS:
                    points[k] = points.get(k, 0) + worth * share
                    share /= 2
        value = {k: (points.get(k, 0) + 25 * (nodes[k]["tag"] in ("article", "main"))) * (1 - linked[k] / chars[k]) for k in nodes}
        top = nodes[max(value, key=lambda k: (value[k], -len(list(self.chain(nodes[k])))))]
        return next((n for n in self.chain(top) if n["tag"] == "article"), top)

    def main(self):
        if not self.blocks:
            return ""
        best = self.best()
        return "\n\n".join(t for n, t, _ in self.blocks if any(m is best for m in self.chain(n)))


def test_against_a_plain_scorer(spark, data):
    got = html.extract(spark.read.parquet(str(data.parent / "sf0.01/pages.parquet"))).join(spark.read.parquet(str(data.parent / "sf0.01/pages.parquet")).select("page_id", "html"), "page_id").collect()
    assert len(got) >= 250
    for r in got:
        assert r.text == Plain(r.html or "").main(), r.page_id
        assert r.n_chars == len(r.text)
