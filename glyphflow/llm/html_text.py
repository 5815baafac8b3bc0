"""Main text of web pages, with templates of a site removed.

A page is read as a stream of tags and text. Subtrees of elements are hashed (names and
text, not attributes); Spark counts, for each host, the distinct page contents that have a
subtree. One that recurs in at least MIN_PAGES of them, however many pages the host has, is
a template of the site and is deleted. Independently, elements that are no article by their
meaning go: navigation, headers, footers, asides, forms, scripts, notices, adverts and
reader comments, by element name, role, or the words in class and id.

The content of a page is its text before templates are deleted, so copies of an article
count once, whatever navigation they stand in. Copies whose other text differs in no marked
element count each.

If a page has <article> or <main>, its text is what remains of them, else what remains of
the body. Inside an <article> or <main> a paragraph-like element is never taken as a
template, because sites repeat an article's sentences too. Outside it is, but an inline
element goes with the words around it, as it is part of their sentence.

The hash index is joined by hash, into which the host goes, and by page, so that a host with
a third of all pages is no single group. Up to SHARED templates are shared with all workers;
beyond, a page's html crosses the network once, by its key.

Defined cases: null counts as empty and gives an empty text; unclosed and stray tags and
unknown entities are read as browsers do, and what a page that is cut off inside a tag has
after that tag's < is no text; any page is parsed in linear time; rows with the same page_id and
html have the same result; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.plans.staging import Workspace

MIN_PAGES = 5
#: Up to so many templates (8 bytes each) are shared with all workers; more meet their pages in a join.
SHARED = 1 << 24
#: Elements nested deeper than this are read as neighbours, as browsers do.
DEEPEST = 512
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_MARK = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Element names by their place in HTML, fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title svg math object canvas select audio video xmp noframes".split())
#: The start of a raw element's end tag; A-Z only are read as a-z.
_RAW_END = {x: re.compile(rf"</{x}(?:[ \t\r\n\f/>]|\Z)", re.I | re.A) for x in RAW}
DROPPED = frozenset("nav header footer aside form button menu dialog fieldset head".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr caption figcaption figure".split()) | INLINE
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Words of class, id and role that mark what is not the article, fixed values.
NOTICE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus dropdown "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion recommended recommendations related replies reply "
    "respond search share sharing shares sidebar signup site-header skip social sponsor sponsored sponsors subscribe subscription tags teaser toolbar tracking trending widget widgets contentinfo complementary alert alertdialog".split()
)
#: Words that say where or in what such a thing stands, and nothing of a layout, fixed values.
NEUTRAL = frozenset("site page top bottom left right box wrap wrapper container list section area block bar inner outer global main item items panel slot unit links link form row col text content title heading buttons button icon icons".split())
_WORD = re.compile(r"[^A-Za-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_LETTER = re.compile(r"[^\W_]")


def host(url: str | None) -> str:
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _named_so(value: str) -> bool:
    """True if a token of class, id or role is a notice word, or joins one to neutral or other notice words.

    So "cookie-notice" and "site-footer" are, and "no-sidebar", "has-sidebar" or
    "search-optimised" are not, which tell of a layout.
    """
    for token in _CAMEL.sub(r"\1-\2", value).lower().split():
        if token in NOTICE:
            return True
        words = [w for w in _WORD.split(token) if w]
        if any(w in NOTICE for w in words) and all(w in NOTICE or w in NEUTRAL for w in words):
            return True
    return False


def _unwanted(name: str, attrs: str) -> int:
    """1 by its element name or because it is hidden, 2 by the words of its attributes, else 0."""
    if name in DROPPED:
        return 1
    if not attrs or name in ("html", "body"):
        return 0
    named = 0
    for m in _ATTR.finditer(attrs):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and re.search(r"display\s*:\s*none", value):
            return 1
        if kind in ("class", "id", "role") and _named_so(value):
            named = 2
    return named


class Node:
    __slots__ = ("name", "kids", "bad", "hash", "size")

    def __init__(self, name: str, bad: int = 0):
        self.name, self.kids, self.bad, self.hash, self.size = name, [], bad, 0, 0


class _Tags:
    """Finds the ends of tags; each character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.none = page, set()

    def find(self, what: str, at: int) -> int:
        """The place of a string, or -1; what is not there is not looked for again."""
        if what in self.none:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.none.add(what)
        return k

    def end(self, at: int) -> int:
        """The place of the > that ends a tag, passing over quoted values, or -1."""
        page = self.page
        while m := _MARK.search(page, at):
            if m[0] == ">":
                return m.start()
            at = m.end()
            k = m.start() - 1
            while page[k] in " \t\r\n\f":
                k -= 1
            if page[k] == "=":
                close = self.find(m[0], at)
                at = close + 1 if close >= 0 else at
        return -1


def parse(page: str) -> Node:
    """The tree of a page; kids are nodes and strings of text as it stands in the page.

    One pass: a tag, comment or raw element that is cut off takes the rest of the page with
    it, as in browsers.
    """
    root = Node("#root")
    stack, tags = _Stack(root), _Tags(page)
    names = stack.names
    at, n = 0, len(page)
    while at < n:
        low = page.find("<", at)
        if low != at:
            stack[-1].kids.append(page[at : low if low >= 0 else n])
            if low < 0:
                break
        nxt = page[low + 1 : low + 2]
        ends = nxt == "/"
        m = _NAME.match(page, low + 1 + ends)
        if m is None:
            if page.startswith("<!--", low):
                end = tags.find("-->", low + 4)
                at = end + 3 if end >= 0 else n
            elif nxt in ("!", "?") or ends and low + 2 < n:
                end = tags.find(">", low)
                at = end + 1 if end >= 0 else n
            else:
                stack[-1].kids.append("<")
                at = low + 1
            continue
        close = tags.end(m.end())
        if close < 0:
            break
        at, name = close + 1, m[0].lower()
        if ends:
            for k in range(len(stack) - 1, 0, -1) if names.get(name) else ():
                if stack[k].name == name:
                    _leave(stack, k)
                    break
            continue
        if name in CLOSES_P:
            _close(stack, "p", ("div", "section", "article", "main", "td", "li", "body", "button"))
        if name == "li":
            _close(stack, "li", ("ul", "ol", "menu"))
        elif name in ("td", "th", "tr"):
            for x in ("td", "th") + (("tr",) if name == "tr" else ()):
                _close(stack, x, ("table",))
        elif name in ("dt", "dd"):
            _close(stack, "dt", ("dl",))
            _close(stack, "dd", ("dl",))
        elif name == "option":
            _close(stack, "option", ("select",))
        alone = page[close - 1] == "/"
        node = Node(name, _unwanted(name, page[m.end() : close - alone]))
        stack[-1].kids.append(node)
        if alone:
            continue
        if name in RAW:
            m = _RAW_END[name].search(page, at)
            end = page.find(">", m.start()) if m else -1
            at = end + 1 if end >= 0 else n
        elif name not in VOID and len(stack) < DEEPEST:
            stack.append(node)
            names[name] = names.get(name, 0) + 1
    _spare_article(root)
    return root


def _spare_article(root: Node) -> None:
    """If words of attributes alone leave a page without its <article> and <main>, these words are disregarded around them."""
    found: list[list[Node]] = []
    todo: list[tuple[Node, tuple]] = [(root, ())]
    while todo:
        node, above = todo.pop()
        if node.bad == 1:
            continue
        above = (node, above) if node.bad else above
        if node.name in ("article", "main"):
            if not above:
                return
            found.append(above)
        todo += [(x, above) for x in node.kids if x.__class__ is Node]
    for above in found:
        while above:
            above[0].bad, above = 0, above[1]


class _Stack(list):
    """Open elements, and how many there are of each name."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.names: dict[str, int] = {}


def _leave(stack: _Stack, k: int) -> None:
    for node in stack[k:]:
        stack.names[node.name] -= 1
    del stack[k:]


def _close(stack: _Stack, name: str, walls: tuple[str, ...]) -> None:
    if not stack.names.get(name):
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name == name:
            _leave(stack, k)
            return
        if stack[k].name in walls or stack[k].bad:
            return


def seal(root: Node, seed: int = 0) -> None:
    """Sets hash and size (characters of text) of all nodes."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.kids if x.__class__ is Node]
    order.reverse()
    for node in order:
        h = xxhash.xxh64(node.name, seed)
        size = 0
        for x in node.kids:
            if x.__class__ is Node:
                h.update(x.hash.to_bytes(8, "little"))
                size += x.size
            else:
                text = " ".join(x.split())
                if text:
                    h.update("\0" + text)
                    size += len(text)
        node.hash, node.size = h.intdigest(), size


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def seed_of(url: str | None) -> int:
    """Equal subtrees of different hosts get different hashes by it."""
    return xxhash.xxh64_intdigest(host(url))


def _candidates(root: Node) -> Iterator[Node]:
    """The subtrees that may be templates."""
    todo = [(root, False, False)]
    while todo:
        node, inside, worded = todo.pop()
        if node.name in RAW or not node.size:
            continue
        if not (node.name in PARAGRAPH and inside or node.name in INLINE and worded or node.name in ("#root", "html", "body", "article", "main")):
            yield node
        inside = inside or node.name in ("article", "main")
        worded = node.name in INLINE and worded or any(x.__class__ is str and _LETTER.search(entities.unescape(x)) for x in node.kids)
        todo += [(x, inside, worded) for x in node.kids if x.__class__ is Node]


def subtree_hashes(root: Node) -> set[int]:
    """Hashes of the subtrees of a sealed page that may be templates."""
    return {_signed(x.hash) for x in _candidates(root)}


def main_text(page: str | None, templates: frozenset[int] | set[int] | np.ndarray = frozenset(), seed: int = 0) -> str:
    """The blocks of the article, one to a line; templates is a set or a sorted array."""
    root = parse(page or "")
    if len(templates):
        seal(root, seed)
        nodes = list(_candidates(root))
        if templates.__class__ is np.ndarray:
            its = np.array([_signed(x.hash) for x in nodes], np.int64)
            at = np.minimum(np.searchsorted(templates, its), len(templates) - 1)
            hit = (templates[at] == its).tolist()
        else:
            hit = [_signed(x.hash) in templates for x in nodes]
        for node, bad in zip(nodes, hit):
            node.bad = node.bad or int(bad)
    return _text(root)


def _text(root: Node) -> str:
    tops = _tops(root, "article") or _tops(root, "main") or [root]
    blocks: list[str] = []
    part: list[str] = []

    def flush() -> None:
        if part:
            text = " ".join(entities.unescape("".join(part)).split())
            part.clear()
            if text:
                blocks.append(text)

    todo: list = [x for top in reversed(tops) for x in (flush, top)]
    while todo:
        x = todo.pop()
        if x is flush:
            flush()
        elif x.__class__ is str:
            part.append(x)
        elif not x.bad:
            if x.name in ("br", "wbr"):
                part.append(" " if x.name == "br" else "")
            elif x.name in INLINE:
                todo += reversed(x.kids)
            else:
                flush()
                todo.append(flush)
                todo += reversed(x.kids)
    flush()
    return "\n".join(blocks)


def _tops(root: Node, name: str) -> list[Node]:
    """The outermost wanted elements of a name, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.bad:
            continue
        if node.name == name:
            out.append(node)
        else:
            todo += [x for x in reversed(node.kids) if x.__class__ is Node]
    return out


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        content, hashes = [], []
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            root = parse(page)
            seal(root, seed_of(url))
            content.append(_signed(xxhash.xxh64_intdigest(_text(root))))
            hashes.append(sorted(subtree_hashes(root)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["page_key", "content", "hashes"])


def _rows(batch: pa.RecordBatch, text: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _rows(batch, [main_text(h, set(t or ()), seed_of(u)) for u, h, t in zip(*(c.to_pylist() for c in batch.columns[1:]))])


def _shared_texts(templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows(batch, [main_text(h, templates.value, seed_of(u)) for u, h in zip(*(c.to_pylist() for c in batch.columns[1:]))])

    return run


def extract_main_text(pages: DataFrame, shared: int = SHARED) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    ws = Workspace(pages.sparkSession, "html")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    key = F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.sha2(F.concat_ws(" ", "url", "html"), 256)).alias("page_key")
    found = ws.keep(p.select(key, "url", "html").mapInArrow(_hashes, "page_key string, content long, hashes array<long>"))
    each = found.select("page_key", "content", F.explode("hashes").alias("hash"))
    often = each.select("hash", "content").distinct().groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    template = ws.keep(often.select(F.col("hash").alias("at_hash")))
    if template.count() <= shared:
        return ws.finish(p.mapInArrow(_shared_texts(pages.sparkSession.sparkContext.broadcast(np.sort(template.toArrow().column("at_hash").to_numpy()))), "page_id long, url string, text string, n_chars long"))
    mine = each.join(template, F.col("hash") == F.col("at_hash")).groupBy(F.col("page_key").alias("at_page")).agg(F.collect_set("hash").alias("templates"))
    whole = p.withColumn("page_key", key).join(ws.keep(mine), F.col("page_key") == F.col("at_page"), "left").select("page_id", "url", "html", "templates")
    return ws.finish(whole.mapInArrow(_texts, "page_id long, url string, text string, n_chars long"))
