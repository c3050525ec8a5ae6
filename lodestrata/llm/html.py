"""Main text of web pages by site template removal.

Pages are parsed into element trees, once to count and once to extract. The hash of each container's subtree is counted for
each host in Spark, over pages of different bodies, so that copies of a page count once; subtrees that recur across pages of
a host are its template and go: containers outside of articles on MIN_PAGES pages, paragraphs there and containers within
articles on MIN_INNER, and in any case on MIN_SHARE of the host's pages. Counting is by (host, subtree), never by host, and each
page meets only the template subtrees that it holds itself. A story that a host has at several addresses is no template: what
holds half of a page's running text (outside of links) stays, and where template in parts would leave less than a fifth of it,
only parts of links and small ones go. Then, as a second line, elements go whose tag, role, class or id says that they are no
article. What is left of the `article` is the text: of all of them in page order, if there are several; else `main`, else the
body.

Within an article, paragraphs, headings and list items never count as template: a passage that many articles quote stays.

Defined cases: null html gives an empty text; a null url has the empty host, on which nothing is template; repeated rows
are extracted each; broken markup is read as far as it goes; time is linear in a page's length, however deep its elements
are; other columns pass through, whatever their names, if they do not begin with two underscores; empty tables stay empty.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, slabs, stage, strings

#: A subtree is template on at least so many different pages of a host (outside of articles; paragraphs, or within), and this
#: share of them.
MIN_PAGES, MIN_INNER, MIN_SHARE = 3, 8, 0.05
#: Template takes at most this share of a page's running text, but for subtrees with less than SMALL of it.
MOST, SMALL = 0.8, 0.05

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|([^<]+|<)", re.S)
_BROKEN = re.compile(r"/?[a-zA-Z]")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
# Element names and words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody thead tfoot tr ul caption".split())
CONTAINERS = frozenset("aside blockquote center dl div fieldset footer form header menu nav ol section table ul".split())
NEVER = frozenset("aside audio button canvas datalist dialog embed footer form frame frameset head iframe input label link map menu meta nav noscript object script select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup sidebar sidebars widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs pagination pager "
    "menu menus nav navbar navigation comment comments commentlist reply replies respond disqus footer masthead toolbar skip login search tracking".split()
)
NO_ARTICLE = frozenset("comment comments related sponsored ad promo".split())
_CLOSES_P = BLOCKS - {"body", "html"}
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
_HIDDEN = re.compile(r"(display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


class Node:
    """holds: an article, main or first heading is below it; frames: an article or main is; inside: it or an element above is one.
    size: characters that are not white space; running: those outside of links."""

    __slots__ = ("attrs", "children", "frames", "hash", "holds", "inside", "running", "size", "tag")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.children, self.hash = tag, attrs, [], None
        self.holds = self.frames = self.inside = False
        self.size = self.running = 0

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.children) if type(x) is not str)

    def get(self) -> dict[str, str]:
        return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(self.attrs)} if self.attrs.strip() else {}


class _Open:
    """The elements that are open, the innermost last, and how many of each tag."""

    def __init__(self, top: Node) -> None:
        self.nodes, self.many = [top], Counter()

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.many[node.tag] += 1

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            self.many[self.nodes.pop().tag] -= 1

    def find(self, tags: tuple[str, ...], until: tuple[str, ...], last: bool = False) -> int:
        """Place of the innermost (or, if last, outermost) element of the tags within the innermost of `until`; 0 for none."""
        found, left = 0, sum(self.many[t] for t in tags)
        for i in range(len(self.nodes) - 1, 0, -1) if left else ():
            tag = self.nodes[i].tag
            if tag in tags:
                found, left = i, left - 1
                if not last or not left:
                    break
            elif tag in until:
                break
        return found


_HOLDS_P = ("table", "td", "th", "button", "li", "div", "article", "section")


def parse(html: str) -> Node:
    """The element tree, with ends that the markup leaves out."""
    top = Node("#root")
    opened = _Open(top)
    pos, size = 0, len(html)
    lower = None
    while pos < size:
        at = opened.nodes[-1]
        m = _TOKEN.match(html, pos)
        if m is None:  # a tag without its end
            at.children.append(unescape(html[pos:]) if html[pos] != "<" else "")
            break
        pos = m.end()
        name = m[3]
        if name is None:
            if m[5] == "<" and _BROKEN.match(html, pos):  # a tag with an open quote, or without an end
                close = html.find(">", pos)
                pos = size if close < 0 else close + 1
            elif m[5] is not None:
                at.children.append(unescape(m[5]) if "&" in m[5] else m[5])
            elif m[1]:
                at.children.append(m[1])
            continue
        name = name.lower()
        if m[2]:
            if opened.many[name]:
                opened.cut(opened.find((name,), ()))
            elif name == "br":
                at.children.append(Node("br"))
            continue
        if name in _CLOSES_P and (k := opened.find(("p",), _HOLDS_P)):
            opened.cut(k)
        if name in _ENDS and (k := opened.find(*_ENDS[name], last=True)):
            opened.cut(k)
        child = Node(name, m[4])
        opened.nodes[-1].children.append(child)
        if name in RAW:
            lower = html.lower() if lower is None else lower
            if len(lower) != size:  # a character's lower case is longer
                end = re.compile(f"</{name}", re.I).search(html, pos)
                stop = end.start() if end else size
            else:
                stop = lower.find(f"</{name}", pos)
                stop = size if stop < 0 else stop
            if name in ("title", "textarea"):
                child.children.append(unescape(html[pos:stop]))
            close = html.find(">", stop)
            pos = size if close < 0 else close + 1
        elif name not in VOID and not m[4].endswith("/"):
            opened.push(child)
    order = list(top.walk())
    for node in order:
        node.inside = node.inside or node.tag in ("article", "main")
        for x in node.children:
            if type(x) is not str:
                x.inside = node.inside
    for node in reversed(order):
        for x in node.children:
            if type(x) is not str:
                node.frames |= x.frames or x.tag in ("article", "main")
                node.holds |= x.holds or x.tag in ("article", "main", "h1")
    return top


def _hashes(top: Node) -> None:
    """Sets each element's hash, of tag, class, id, texts without outer white space and children."""
    order = list(top.walk())
    for node in reversed(order):
        h = xxhash.xxh3_64(node.tag)
        h.update(node.attrs.strip().encode("utf-8", "surrogatepass"))
        for x in node.children:
            if type(x) is str:
                x = " ".join(x.split())
                if x:
                    h.update(b"\x01" + x.encode("utf-8", "surrogatepass"))
            else:
                h.update(b"\x02" + x.hash.to_bytes(8, "little"))
        node.hash = h.intdigest()


def _candidates(top: Node) -> Iterator[tuple[Node, int]]:
    """Elements that may be template, with their key: the hash, whose last bit says that many pages are asked for; signed."""
    for node in top.walk():
        if (node.tag in CONTAINERS or node.tag == "p" and not node.inside) and not node.holds:
            key = node.hash & ~1 | (node.inside or node.tag == "p")
            yield node, key - (1 << 64) if key >> 63 else key


def subtrees(html: str) -> tuple[int, list[int]]:
    """The body's hash, and the keys of what may be template; signed 64-bit."""
    top = parse(html)
    _hashes(top)
    return top.hash - (1 << 64) if top.hash >> 63 else top.hash, sorted({k for _, k in _candidates(top)})


def _named(attrs: dict[str, str], names: frozenset) -> bool:
    return any(p.lower() in names for k in ("class", "id") for p in _PART.findall(attrs.get(k, "")))


def _boilerplate(node: Node) -> bool:
    tag = node.tag
    if tag in NEVER:
        return not (tag in ("form", "label") and node.holds)
    if tag == "header":
        return not node.inside and not node.frames
    if not node.attrs.strip():
        return False
    attrs = node.get()
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attrs.get("style", "")):
        return True
    if tag in ("html", "body", "main") or node.holds:
        return False
    if tag == "article":
        return _named(attrs, NO_ARTICLE)
    return attrs.get("role", "").lower() in ROLES or _named(attrs, NAMES)


def _sizes(top: Node) -> None:
    """Sets each element's number of characters that are not white space, and of those outside of links."""
    for node in reversed(list(top.walk())):
        node.size = node.running = 0
        for x in node.children:
            if type(x) is str:
                n = sum(map(len, x.split()))
                node.size += n
                node.running += n
            else:
                node.size += x.size
                node.running += x.running
        if node.tag == "a":
            node.running = 0


def _template(top: Node, template: frozenset[int]) -> set[int]:
    """ids of the elements that go: those of the template, but for a page's main running text."""
    _hashes(top)
    _sizes(top)
    found = {id(x): x for x, k in _candidates(top) if k in template and 2 * x.running < max(1, top.running)}
    taken = sum(x.running for x in _outermost(top, lambda x: id(x) in found))
    if taken > MOST * top.running:
        found = {k: x for k, x in found.items() if x.running < SMALL * top.running or 2 * x.running <= x.size}
    return set(found)


def _outermost(top: Node, wanted) -> list[Node]:
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        if wanted(node):
            out.append(node)
        else:
            stack.extend(x for x in reversed(node.children) if type(x) is not str)
    return out


def _roots(top: Node) -> list[Node]:
    """The elements that make up the article, in page order."""
    _sizes(top)
    articles = [x for x in _outermost(top, lambda x: x.tag == "article") if x.size]
    if articles:
        return articles
    return [x for x in _outermost(top, lambda x: x.tag == "main" or x.get().get("role") == "main") if x.size] or _outermost(top, lambda x: x.tag == "body") or [top]


def extract(html: str, template: frozenset[int] = frozenset()) -> str:
    """The article's blocks, joined by an empty line."""
    top = parse(html)
    gone = _template(top, template) if template else set()
    stack = [top]
    while stack:
        node = stack.pop()
        node.children = [x for x in node.children if type(x) is str or not (id(x) in gone or _boilerplate(x))]
        stack.extend(x for x in node.children if type(x) is not str)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        block = " ".join("".join(line).split())
        line.clear()
        if block:
            blocks.append(block)

    todo: list = [y for x in reversed(_roots(top)) for y in (None, x)]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif type(x) is str:
            line.append(x)
        elif x.tag in ("br", "td", "th", "img"):
            line.append(" ")
            todo.extend(reversed(x.children))
        elif x.tag in BLOCKS:
            flush()
            todo.append(None)
            todo.extend(reversed(x.children))
        else:
            todo.extend(reversed(x.children))
    flush()
    return "\n\n".join(blocks)


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slabs(batches, "__html"):
        found = [subtrees(x) for x in strings(batch.column("__html"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("__page"), batch.column("__at"), batch.column("__host"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64()))],
            ["__page", "__at", "__host", "__body", "__trees"],
        )


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract_main_text(df: DataFrame, html: str = "html", url: str = "url", page: str = "page_id", min_pages: int = MIN_PAGES, min_inner: int = MIN_INNER, min_share: float = MIN_SHARE) -> DataFrame:
    """df without `html`, with __main."""
    keep = [c for c in df.columns if c != html]
    rows = df.withColumns({"__page": F.col(page), "__html": F.coalesce(F.col(html).cast("string"), F.lit("")), "__host": host(F.col(url))})
    rows = rows.withColumn("__at", F.xxhash64("__html", "__host"))
    kind = df.schema[page].dataType.simpleString()
    listed = map_arrow(rows.select("__page", "__at", "__host", "__html"), _list, f"__page {kind}, __at bigint, __host string, __body bigint, __trees array<bigint>")
    trees = stage(listed.filter("__host <> ''"), "trees")
    each = trees.select("__page", "__at", "__host", "__body", F.explode("__trees").alias("__tree"))
    pages = trees.select("__host", "__body").distinct().groupBy("__host").agg(F.count(F.lit(1)).alias("__all"))
    often = (
        each.select("__host", "__tree", "__body").distinct().groupBy("__host", "__tree").agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") >= F.when(F.col("__tree").bitwiseAND(F.lit(1)) == 1, min_inner).otherwise(min_pages))
        .join(pages, "__host").filter(F.col("__n") >= F.col("__all") * min_share).select("__host", "__tree")
    )
    own = (
        each.join(often, ["__host", "__tree"]).select(F.col("__page").alias("__p"), F.col("__at").alias("__a"), "__tree").distinct()
        .groupBy("__p", "__a").agg(F.collect_list("__tree").alias("__template"))
    )
    both = rows.join(own, rows["__page"].eqNullSafe(own["__p"]) & (rows["__at"] == own["__a"]), "left").select(*[f"`{c}`" for c in keep], "__html", "__template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "__html"):
            out = [extract(x, frozenset(t or ())) for x, t in zip(strings(batch.column("__html")), batch.column("__template").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], [*keep, "__main"])

    return map_arrow(both, run, T.StructType([*(both.schema[c] for c in keep), T.StructField("__main", T.StringType())]))


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", F.col("__main").alias("text"), F.length("__main").cast("long").alias("n_chars"))
