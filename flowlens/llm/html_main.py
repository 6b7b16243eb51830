"""Main text of web pages: site template removal over hashed element subtrees.

Every page is parsed into a tree whose subtrees are hashed: containers with any
text, other elements with more than a few words.  Spark counts, for each host, on
how many different pages a hash occurs; what recurs on many of them is the site's
template and is deleted.  Elements whose tag, role or class says that they aren't
the article (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
comments) go in any case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import cut, small_batches, with_columns

#: A container is template if it stands on this share of the host's different pages, on MIN_PAGES of them at
#: least; MAX_PAGES of them are enough however large the host.  Other elements, which may be a quoted
#: paragraph, stand on MIN_TEXT_PAGES at least.
MIN_PAGES, MIN_TEXT_PAGES, MIN_SHARE, MAX_PAGES = 4, 6, 0.1, 50
#: Words that make an element other than a container worth counting.
MIN_WORDS = 4
#: So many templates (8 bytes each) are broadcast; more are joined to the pages by a shuffle.
MAX_BROADCAST = 1_000_000

# Element names (fixed values of the markup language).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("head title script style noscript template nav footer aside form button select textarea iframe "
                    "svg canvas object embed audio video dialog menu map math".split())
CONTAINERS = frozenset("div section aside nav header footer ul ol dl table form main figure center td".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar "
                  "toolbar tablist note status".split())
#: Names of classes and ids that say an element isn't the article.
NAMES = frozenset("nav navbar navigation menu submenu masthead topbar footer sidebar widget widgets advert adverts "
                  "advertisement advertisements advertising sponsored banner cookie cookies gdpr popup modal newsletter "
                  "subscribe signup breadcrumb breadcrumbs pagination pager toolbar searchbox comments commentlist disqus "
                  "replies copyright".split())
#: Of these, names of what readers write: an article inside is a comment.
_READERS = frozenset("comments comment commentlist disqus replies".split())
#: Names that say so as a whole class only, or before a word for a part of a page.
LOOSE = frozenset("header side rail ad ads adv sponsor sponsors promo promotion consent notice notices notification alert "
                  "overlay subscription login register share sharing social related recommended recommendations comment "
                  "skip search legal".split())
PARTS = frozenset("bar box button buttons links link list block area section wrapper container form panel slot unit icons "
                  "posts articles stories items widget banner banners menu message modal popup thread left right top bottom primary secondary".split())
#: Words that turn a name into a property of the layout.
_TURNED = frozenset("has no not with without".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open paragraph, and those that end an open element of their own kind.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                    "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"},
             "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPES = frozenset("ul ol dl table div section article main body html nav aside td th".split())
_WORD = re.compile(r"[a-z]+")


#: What a head may hold; anything else ends one that is open.
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())


@dataclass(eq=False)
class Node:
    tag: str
    dropped: bool = False
    name: str = ""
    spared: bool = False  #: dropped only if the page's main or article isn't in it
    named: bool = False  #: dropped only if there is other text
    children: list[Node | str] = field(default_factory=list)
    digest: int = 0
    counted: bool = False  #: may be template


def _names_boilerplate(token: str, is_class: bool) -> bool:
    """Whether one class or id is a name of a part that isn't the article."""
    words = _WORD.findall(token)
    if not words or _TURNED & set(words):
        return False
    if token in NAMES:
        return True
    if len(words) == 2 and words[1] in NAMES:  # site-footer, main-nav
        return True
    if len(words) == 2 and words[0] in NAMES | LOOSE and words[1] in PARTS:
        return True
    return words[0] in LOOSE and is_class and token == words[0]


def _is_dropped(tag: str, attrs: dict[str, str | None], in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element isn't the article, whether it is spared if the page's article is in it,
    and whether only its names say so.

    A form may wrap a whole page, as may an element with a role or a name that its
    layout gives it; a script or what is hidden may not.
    """
    if tag in DROPPED or (tag == "header" and not in_article):
        return True, tag in ("form", "header"), False
    if tag in ("html", "body") or (tag == "main" and not in_article):
        return False, False, False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True, False, False
    if (attrs.get("role") or "").lower() in ROLES:
        return True, True, False
    if "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
        return True, False, False
    names = [token for a in ("class", "id") for token in (attrs.get(a) or "").lower().split() if _names_boilerplate(token, a == "class")]
    if tag in _HEADINGS or not names:
        return False, False, False
    by_layout = not any(_READERS & set(_WORD.findall(n)) for n in names)
    return True, by_layout, by_layout


class _Builder(HTMLParser):
    """Tree with the implied end tags that matter for text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open: list[Node] = [self.root]

    def _close(self, at: int) -> None:
        del self.open[max(1, at):]

    def _end_head(self) -> None:
        """Close a head that is open: its end tag may be left out."""
        for i in range(1, len(self.open)):
            if self.open[i].tag == "head":
                self._close(i)
                return

    def handle_starttag(self, tag, attrs):
        if tag not in _HEAD and tag not in ("html", "head"):
            self._end_head()
        if tag in ("html", "body"):
            return
        if tag in _ENDS_P or tag in _SIBLINGS:
            ends = ({"p"} if tag in _ENDS_P else set()) | _SIBLINGS.get(tag, set())
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in ends:
                    self._close(i)
                    if tag not in ("tr", "thead", "tbody", "tfoot"):
                        break
                elif self.open[i].tag in _SCOPES and not (tag in ("tr", "tbody", "tfoot") and self.open[i].tag in ("td", "th")):
                    break
        values = dict(attrs)
        inside = any(n.tag in ("article", "main") for n in self.open)
        dropped, spared, named = _is_dropped(tag, values, inside)
        node = Node(tag, dropped, (values.get("class") or "").lower(), spared, named)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and len(self.open) > 1 and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in ("html", "body") or tag in VOID:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._close(i)
                return
            if tag in INLINE and self.open[i].tag not in INLINE:
                return

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self._end_head()
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    _spare(b.root)
    return b.root


def _spare(root: Node) -> None:
    """Keep elements that the rules would drop though the page's text is in them.

    If no main or article is left, those that hold one stay; if no text at all is
    left, the one with the most text that only its class or id drops stays, and so on into it.
    """
    held = [n for n in _kept(root) if n.dropped and n.spared]
    if held and not any(n.tag in ("main", "article") for n in _kept(root) if not n.dropped):
        for n in held:
            if any(c.tag in ("main", "article") for c in _ordered(n)[1:]):
                n.dropped = False
    while not text_of([root]):
        held = [n for n in _kept(root) if n.dropped and n.named]
        if not held:
            return
        for n in held:
            n.dropped = False
        size = [len(text_of([n])) for n in held]
        for n in held:
            n.dropped = True
        held[size.index(max(size))].dropped = False


def _kept(root: Node) -> list[Node]:
    """Nodes in page order, a dropped one without what is in it; without recursion."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        if not n.dropped:
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out


def _ordered(root: Node) -> list[Node]:
    """Nodes, parents first; without recursion, as pages may nest deeply."""
    out = [root]
    for n in out:
        out += [c for c in n.children if isinstance(c, Node)]
    return out


def hash_subtrees(root: Node) -> list[Node]:
    """Set each node's digest from its tag, class, text and children; return the nodes worth counting.

    These are containers with text and other elements of MIN_WORDS words or more,
    outside what the rules drop.
    """
    found = []
    words: dict[int, int] = {}
    order = _ordered(root)
    gone: set[int] = set()
    for n in order:
        if n.dropped or id(n) in gone:
            gone |= {id(c) for c in n.children if isinstance(c, Node)}
    for n in reversed(order):
        h = xxhash.xxh64(f"{n.tag}|{n.name}".encode())
        count = 0
        for c in n.children:
            if isinstance(c, Node):
                h.update(c.digest.to_bytes(8, "little"))
                count += words[id(c)]
            elif own := c.split():
                h.update(" ".join(own).encode("utf-8", "surrogatepass"))
                count += len(own)
        n.digest = h.intdigest()
        words[id(n)] = count
        n.counted = (count >= (1 if n.tag in CONTAINERS else MIN_WORDS) and n is not root
                     and not n.dropped and id(n) not in gone)
        if n.counted:
            found.append(n)
    return found


def _outermost(root: Node, tag: str) -> list[Node]:
    """The outermost elements of a kind; none inside a dropped element."""
    found, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.dropped:
            continue
        if n.tag == tag:
            found.append(n)
        else:
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]
    return found


def page_text(root: Node, templates: frozenset[int] = frozenset()) -> str:
    """Text of the mains if they hold most of the page's text that isn't dropped, else of the articles
    if these do, else of the page."""
    whole = text_of([root], templates)
    for tag in ("main", "article"):
        if found := _outermost(root, tag):
            part = text_of(found, templates)
            if 2 * len(part) > len(whole):
                return part
    return whole


def text_of(roots: list[Node], templates: frozenset[int] = frozenset()) -> str:
    """Text of the blocks; elements dropped by rule or found in `templates` are left out."""
    parts: list[str] = []
    stack: list[Node | str] = list(reversed(roots))
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            parts.append(n)
            continue
        if n.dropped or (n.counted and n.digest in templates):
            continue
        edge = [] if n.tag in INLINE else [" "]
        stack += [*edge, *reversed(n.children), *edge]
    return " ".join("".join(parts).split())


def main_text(html: str | None, templates: frozenset[int] = frozenset()) -> str:
    if not html:
        return ""
    root = parse(html)
    if templates:
        hash_subtrees(root)
    return page_text(root, templates)


def _site_key(host: str, node: Node) -> int:
    """63 bits for a subtree on a host; the last one is set for containers."""
    h = xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"), node.digest)
    return h >> 2 << 1 | (node.tag in CONTAINERS)


def _page_key(host: str, html: str) -> int:
    """63 bits for a page of a host, equal for copies."""
    page = xxhash.xxh64_intdigest(html.encode("utf-8", "surrogatepass"))
    return xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"), page) >> 1


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, keys, pages = [], [], []
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            page = _page_key(host, html)
            # a row of key 0 counts the page itself
            own = {0, *(_site_key(host, n) for n in hash_subtrees(parse(html)))}
            hosts += [host] * len(own)
            keys += own
            pages += [page] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()),
                                          pa.array(pages, pa.int64())], names=["host", "key", "page"])


def host_of(url):
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, key, page): the subtrees of each page (host, html); key 0 stands for the page itself."""
    small_batches(pages.sparkSession)
    return pages.filter("host <> '' and html is not null").mapInArrow(_subtrees, "host string, key long, page long")


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_text_pages: int = MIN_TEXT_PAGES,
                   min_share: float = MIN_SHARE, max_pages: int = MAX_PAGES) -> DataFrame:
    """(key): subtrees on `min_share` of the host's pages, `min_pages` at least (`min_text_pages` for
    elements that aren't containers) and `max_pages` at most.

    Equal pages count once.  Counts are taken over (host, key, page) rows, so a
    large host is no single group.
    """
    once = occurrences(pages).distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    once = cut(once.filter((F.col("n") >= min(min_pages, max_pages)) | (F.col("key") == 0)))
    size = once.filter("key = 0").select("host", F.col("n").alias("pages"))
    least = F.when(F.col("key") % 2 == 1, F.lit(float(min_pages))).otherwise(F.lit(float(max(min_pages, min_text_pages))))
    enough = F.least(F.lit(float(max_pages)), F.greatest(least, F.lit(min_share) * F.col("pages")))
    return once.filter("key <> 0").join(size, "host").filter(F.col("n") >= enough).select("key")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", **params) -> DataFrame:
    """`pages` with text (main text, empty if none) and n_chars (its code points).

    Null and empty html give empty text; long pages are taken whole.  Pages without
    a host in their url have no site: only the rules apply.  Columns called text or n_chars are replaced;
    repeated rows get equal results.
    """
    spark = pages.sparkSession
    small_batches(spark)
    host = F.coalesce(host_of(F.col(f"`{url_col}`")), F.lit(""))
    html = F.col(f"`{html_col}`")
    slim = pages.select(host.alias("host"), html.alias("html"))
    keys = cut(site_templates(slim, **params))
    out = pages.withColumn("__hm_site", host)
    if keys.count() <= MAX_BROADCAST:
        shared = spark.sparkContext.broadcast(np.sort(keys.toArrow()["key"].to_numpy()))

        @F.pandas_udf("string")
        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for html, site in parts:
                yield pd.Series([_extract(h if isinstance(h, str) else None, s, shared.value)
                                 for h, s in zip(html, site, strict=True)], dtype=object)

        out = out.withColumn("__hm_text", run(html, F.col("__hm_site")))
    else:
        out = _joined(out, slim, html, keys)
    out = with_columns(out, text=F.col("__hm_text"), n_chars=F.length("__hm_text").cast("long"))
    return out.drop("__hm_site", "__hm_text")


def _joined(out: DataFrame, slim: DataFrame, html: Column, keys: DataFrame) -> DataFrame:
    """`out` with __hm_text: each page gets the templates that stand on it, never all of its host."""
    @F.pandas_udf("long")
    def number(site: pd.Series, html: pd.Series) -> pd.Series:
        return pd.Series([_page_key(s, h if isinstance(h, str) else "") for s, h in zip(site, html, strict=True)],
                         dtype="int64")

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, site, own in parts:
            yield pd.Series([_extract(h if isinstance(h, str) else None, s, np.sort(np.array([] if k is None else k, np.int64)))
                             for h, s, k in zip(html, site, own, strict=True)], dtype=object)

    of_page = (occurrences(slim).select("key", "page").distinct().join(keys, "key")
               .groupBy(F.col("page").alias("__hm_of")).agg(F.collect_list("key").alias("__hm_keys")))
    out = out.withColumn("__hm_page", number("__hm_site", html))
    out = out.join(of_page, F.col("__hm_page") == F.col("__hm_of"), "left")
    return out.withColumn("__hm_text", run(html, "__hm_site", "__hm_keys")).drop("__hm_page", "__hm_of", "__hm_keys")


def _extract(html: str | None, host: str, keys: np.ndarray) -> str:
    """Text of a page; `keys`: sorted keys of templates."""
    if not html:
        return ""
    root = parse(html)
    if not host or not len(keys):
        return page_text(root)
    nodes = hash_subtrees(root)
    own = np.array([_site_key(host, n) for n in nodes], np.int64)
    hit = keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own
    return page_text(root, frozenset(n.digest for n, h in zip(nodes, hit.tolist(), strict=True) if h))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
