"""Main text of web pages, with removal of the templates of each site.

A page is parsed into a tree that tolerates bad markup. Element subtrees are hashed (tag, class,
text, children), and Spark counts for each host with how many contents a subtree occurs: pages with the
same text by the rules below count once, so copies of a page, with other menus too, make no template of
its content. Subtrees with at least ``MIN_PAGES`` contents, however many the host has, are template and are deleted, save for
prose elements of an article, which are content even when a site repeats them. What remains is
reduced by the meaning of tags, roles and class names to the article and written out by blocks.

Plan: the first scan emits a key of host and subtree, and the content's hash, once a page; distinct rows are
dealt by both and counted with map-side combining, so a host with a third of all pages is no hot group. Up to ``BROADCAST_ROWS`` recurring keys are broadcast
as numbers, and the html is not shuffled. Beyond that, each page is joined to those of its own keys that
recur, by a hash of host and html. The second scan extracts.

Defined results: a null or empty html gives an empty text. Pages without a host (null url) have no
template removal. Repeated pages count once for templates and give a row each. An empty table gives an empty
result. Other columns pass through, unless they are named ``text``, ``n_chars`` (replaced) or ``_ht_*``.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Collection, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballastry.llm.common import checkpointed, table
from ballastry.llm.url_reputation import host_of

MIN_PAGES = 10
BROADCAST_ROWS = 500_000

TOKENS = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<!\w[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|<[/a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Opening the key ends an open element of the set, looking no further out than the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
DROPPED_TAGS = set("head script style noscript template iframe noembed noframes svg math object canvas audio video map nav footer aside form button select option datalist input textarea dialog menu title".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
DROPPED_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments disqus respond replies share sharing social related recommended widget login search skip paywall pagination pager".split()
)
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption b i em strong a span code br img article main".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "hash")

    def __init__(self, tag: str, attrs: str) -> None:
        self.tag, self.attrs, self.kids, self.hash = tag, attrs, [], 0


class _Open:
    """The open elements, and where on the stack those of each name are, so that stray tags search nothing."""

    def __init__(self, root: Node) -> None:
        self.stack: list[Node] = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def close(self, tags: Collection[str], within: Collection[str]) -> None:
        """Closes the innermost element named in tags with all inside it, unless one named in within is further in."""
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)
        if at == 0 or any(self.places[t][-1] > at for t in within if self.places.get(t)):
            return
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()


def parse(text: str) -> Node:
    root = Node("#root", "")
    opened = _Open(root)
    stack = opened.stack
    at, end = 0, len(text)

    def words(a: int, b: int) -> None:
        if b > a:
            stack[-1].kids.append(text[a:b])

    while at < end:
        m = TOKENS.search(text, at)
        if not m:
            words(at, end)
            break
        words(at, m.start())
        at = m.end()
        if not m[2] or not m[4]:
            continue  # a comment, a declaration, or a tag that the page's end cuts off
        tag = m[2].lower()
        if m[1]:
            opened.close({tag}, set())
            continue
        if tag in BLOCKS:
            opened.close({"p"}, {"button", "table", "td", "th", "article", "section", "div", "main", "body"})
        if tag in ENDS:
            opened.close(*ENDS[tag])
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(text, at)
            node.kids.append(text[at : close.start() if close else end])
            at = close.end() if close else end
        elif not m[3].endswith("/") or tag in BLOCKS:
            opened.push(node)
    return root


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """All elements before their parents, and whether each is inside an article."""
    todo, out = [(root, False)], []
    while todo:
        node, inside = todo.pop()
        out.append((node, inside))
        inside = inside or node.tag in ("article", "main")
        todo += [(k, inside) for k in node.kids if type(k) is Node]
    return reversed(out)


def _hash_all(root: Node) -> list[tuple[Node, bool]]:
    """Sets the hash of every subtree; the candidates for removal."""
    found = []
    for node, inside in _walk(root):
        parts = [node.tag, *sorted(f"{k}={v}" for k, v in attributes(node).items() if k in ("class", "id", "role"))]
        parts += [" ".join(k.split()) if type(k) is str else f"\0{k.hash}" for k in node.kids]
        node.hash = xxhash.xxh3_64_intdigest("\1".join(parts)) - (1 << 63)
        if node.tag not in ("#root", "html", "head", "body") and not (node.tag in PROSE and (inside or node.tag in ("article", "main"))):
            found.append(node)
    return found


def attributes(node: Node) -> dict[str, str]:
    if not node.attrs.strip(" /"):
        return {}
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(node.attrs):
        out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _boilerplate(node: Node, inside: bool) -> bool:
    if node.tag in DROPPED_TAGS or node.tag == "header" and not inside:
        return True
    if not node.attrs:
        return False
    a = attributes(node)
    if "hidden" in a or a.get("role", "").lower() in DROPPED_ROLES or "display:none" in a.get("style", "").replace(" ", "").lower() or a.get("aria-hidden") == "true":
        return True
    names = re.split(r"[\s_-]+", f"{a.get('class', '')} {a.get('id', '')}".lower())
    return node.tag not in ("html", "body", "article", "main") and any(n in DROPPED_NAMES for n in names)


def host_key(host: str) -> int:
    """What a subtree's hash is combined with (xor) for its key on a host."""
    return xxhash.xxh3_64_intdigest(host) - (1 << 63)


def subtree_keys(host: str, text: str | None) -> tuple[list[int], int]:
    """The keys of a page's subtrees on its host, and the hash of its text with templates."""
    own, root = host_key(host), parse(text or "")
    return list({n.hash ^ own for n in _hash_all(root)}), xxhash.xxh3_64_intdigest(_text_of(root, set())) - (1 << 63)


def main_text(text: str | None, templates: Collection[int] = frozenset(), host: str = "") -> str:
    """The text of the page's articles, or of its body where it has none, a block a line; without its host's templates."""
    if not text:
        return ""
    root = parse(text)
    own = host_key(host)
    return _text_of(root, {id(n) for n in _hash_all(root) if n.hash ^ own in templates} if templates else set())


def _text_of(root: Node, gone: set[int]) -> str:
    articles, todo = [], [root]
    while todo:  # the outermost articles that are not boilerplate, in page order
        node = todo.pop()
        if id(node) in gone or _boilerplate(node, False):
            continue
        if node.tag in ("article", "main"):
            articles.append(node)
            continue
        todo += [k for k in reversed(node.kids) if type(k) is Node]
    blocks: list[str] = []
    own: list[str] = []

    def cut() -> None:
        block = " ".join(entities.unescape("".join(own)).split())
        own.clear()
        if block:
            blocks.append(block)

    for top in articles or [root]:
        todo = [(top, bool(articles))]
        while todo:
            node, inside = todo.pop()
            if type(node) is str:
                own.append(node)
            elif node is None:
                cut()
            elif id(node) in gone or (node is not top and _boilerplate(node, inside)):
                if node.tag in BLOCKS:
                    cut()
            else:
                if node.tag in BLOCKS:
                    cut()
                    todo.append((None, inside))
                elif node.tag == "br":
                    own.append(" ")
                todo += [(k, inside) for k in reversed(node.kids)]
        cut()
    return "\n".join(blocks)


def _subtrees(pages: DataFrame) -> DataFrame:
    """(page, content, key) of every subtree of the pages that have a host; page is their hash of host and html."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.iloc[k : k + 200]
                found = [subtree_keys(h, t) for h, t in zip(part["host"], part["html"], strict=True)]
                keys, contents = zip(*found, strict=True)
                out = pd.DataFrame({"page": part["page"], "content": contents, "key": keys}).explode("key").dropna()
                yield out.astype({"key": "int64"})

    hosted = pages.select(host_of(F.col("url")).alias("host"), "html").where("host <> ''")
    return hosted.withColumn("page", _page()).mapInPandas(rows, "page long, content long, key long")


def _page(host: str = "host") -> Column:
    return F.xxhash64(host, "html")


def template_keys(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(key) of the subtrees that recur on a host."""
    return _subtrees(pages).select("key", "content").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).select("key")


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """pages (url, html and others) with text and n_chars."""
    found = checkpointed(template_keys(pages, min_pages))  # counted and used, but pages are parsed for it once
    hosted = pages.withColumn("_ht_of", host_of(F.col("url")))
    if found.limit(broadcast_rows + 1).count() <= broadcast_rows:
        shared = pages.sparkSession.sparkContext.broadcast(found.toArrow()["key"].to_numpy())

        @F.pandas_udf(T.StringType())
        def extracted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            templates = frozenset(shared.value.tolist())
            for html, hosts in batches:
                yield pd.Series([main_text(t, templates if h else frozenset(), h or "") for t, h in zip(html, hosts, strict=True)], dtype=object)

        texts = hosted.withColumn("text", extracted("html", "_ht_of"))
    else:
        own = _subtrees(pages).select("page", "key").distinct().join(found, "key").groupBy(F.col("page").alias("_ht_page")).agg(F.collect_list("key").alias("_ht_templates"))

        @F.pandas_udf(T.StringType())
        def extracted_by(html: pd.Series, hosts: pd.Series, templates: pd.Series) -> pd.Series:
            rows = zip(html, hosts, templates, strict=True)
            return pd.Series([main_text(t, frozenset(k) if h and k is not None else frozenset(), h or "") for t, h, k in rows], dtype=object)

        joined = hosted.join(own, _page("_ht_of") == F.col("_ht_page"), "left")
        texts = joined.withColumn("text", extracted_by("html", "_ht_of", "_ht_templates"))
    out = texts.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*[c for c in pages.columns if c not in ("text", "n_chars")], "text", "n_chars")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
