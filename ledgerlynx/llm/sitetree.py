"""Main text of web pages by a site style tree."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlynx.llm.common import as_rows, doc_field, written

#: Share of a node's own style in its importance, pages a host needs before its tree
#: is trusted, and the importance below which a branch is removed.
GAMMA, LEAST_PAGES, LOW = 0.9, 4, 0.3

# The names that HTML and common page templates give to these parts.
HIDDEN = frozenset("script style noscript template head title svg iframe object embed canvas audio video "
                   "map select option datalist annotation annotation-xml".split())
NOISE_TAGS = frozenset("nav footer aside form button input textarea label fieldset dialog menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert "
                        "toolbar".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
                        "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget cookie cookies "
                        "consent notice notices gdpr popup modal overlay comment comments disqus reply replies "
                        "footer masthead share sharing social related recommended newsletter subscribe signup "
                        "login search form toolbar pagination pager".split())
# a name that begins so tells what the page has elsewhere, or has not
MODIFIERS = frozenset("has with no without hide".split())
MAIN_TAGS = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp "
                   "small span strike strong sub sup time tt u var wbr math mrow mi mn mo ms mtext mspace mfrac msqrt "
                   "mroot msub msup msubsup munder mover munderover mstyle semantics annotation".split())
# an opening tag on the left ends open elements of the names on the right
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
           "tfoot": {"thead", "tbody", "tr", "td", "th"}}
_SCOPE = frozenset("ul ol dl table html body div article section main aside nav footer header form blockquote".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|"
                    r"<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


class Node:
    __slots__ = ("tag", "style", "noise", "named", "main", "parent", "children")

    def __init__(self, tag: str, style: str, noise: bool, named: bool, main: bool, parent: Node | None):
        # noise by its tag, role or attributes (noise), or only by its class or id (named)
        self.tag, self.style, self.noise, self.named, self.main, self.parent = tag, style, noise, named, main, parent
        self.children: list[str] = []


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(text)} if text else {}


@lru_cache(maxsize=1 << 14)
def _kind(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Style of an element, whether it is noise by tag, role or attributes, whether
    its class or id names it so, whether it marks the main part."""
    a = _attributes(attributes) if "=" in attributes or "hidden" in attributes else {}
    names = " ".join(sorted(a.get("class", "").lower().split()))
    split = [_SPLIT.split(name) for name in [*names.split(), a.get("id", "").lower()]]
    words = {w for part in split if part[0] not in MODIFIERS for w in part}
    noise = (tag in HIDDEN or tag in NOISE_TAGS or a.get("role", "").lower() in NOISE_ROLES
             or "hidden" in a or a.get("aria-hidden") == "true"
             or "display:none" in a.get("style", "").replace(" ", ""))
    named = bool(words & NOISE_WORDS) and tag not in ("html", "body", "article", "main")
    return tag + ("." + names if names else ""), noise, named, tag in MAIN_TAGS or a.get("role", "").lower() == "main"


def _element(tag: str, attributes: str, parent: Node) -> Node:
    style, noise, named, main = _kind(tag, attributes)
    parent.children.append(style)
    # a page's header is furniture, an article's header is not
    return Node(tag, parent.style + "/" + style, noise or parent.noise or (tag == "header" and not parent.main),
                named or parent.named, main or parent.main, parent)


def parse(page: str | None) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Elements and text blocks (the element a block stands in, its text) in page order.

    Unclosed and wrongly nested tags are closed as browsers do in common cases;
    a ``<`` that starts no tag is text. Comments and markup are no text.
    """
    page = page or ""
    root = Node("", "", False, False, False, None)
    nodes, blocks, open_, parts = [root], [], [root], []
    block_of = root

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((block_of, text))
            parts.clear()

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            if not parts:
                block_of = _block(open_)
            parts.append(text)
        if not m:
            break
        at = m.end()
        tag = m[2].lower() if m[2] else None
        if tag is None:
            continue
        if not m[1]:
            attributes = m[3]
            if tag in INLINE and tag != "br":
                node = _element(tag, attributes, open_[-1])
                if _out(node) and not _out(open_[-1]):
                    flush()  # an inline advert or hidden piece is no part of the block around it
                nodes.append(node)
                if tag not in VOID:
                    open_.append(node)
                continue
            if tag == "br":
                parts.append(" ")
                continue
            flush()
            _close_implied(open_, tag)
            node = _element(tag, attributes, open_[-1])
            nodes.append(node)
            if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
                continue
            open_.append(node)
            if tag in RAW:
                end = re.compile(r"</" + re.escape(tag) + r"(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
                open_.pop()
        else:
            names = [n.tag for n in open_]
            if tag not in names:
                continue
            deep = len(names) - 1 - names[::-1].index(tag)
            if tag in INLINE:
                if any(n.tag not in INLINE for n in open_[deep:]):
                    continue  # it would close blocks
                if any(_out(n) for n in open_[deep:]) and not _out(open_[deep - 1]):
                    flush()
                del open_[deep:]
            else:
                flush()
                del open_[deep:]
    flush()
    return nodes, blocks


def _out(node: Node) -> bool:
    return node.noise or node.named


def _block(open_: list[Node]) -> Node:
    """The innermost open element that is a block, or noise."""
    for node in reversed(open_):
        if node.tag not in INLINE:
            return open_[-1] if _out(open_[-1]) and not _out(node) else node
    return open_[0]


def _close_implied(open_: list[Node], tag: str) -> None:
    # formatting left open does not reach into the next block
    while open_[-1].tag in INLINE:
        open_.pop()
    if open_[-1].tag == "p":
        open_.pop()
    elif open_[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6") and tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        open_.pop()
    ends = _CLOSES.get(tag)
    if ends:
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in ends:
                del open_[i:]
            elif open_[i].tag in _SCOPE:
                break


def host_of(url: str | None) -> str:
    """Host in lower case without scheme, login, port and path; empty if there is none."""
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _host(url: Column) -> Column:
    @F.pandas_udf("string")
    def host(urls: pd.Series) -> pd.Series:
        return urls.map(host_of, na_action=None)

    return host(url)


_STATS = "host string, node long, parent long, feature long, presentation boolean, n double"


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many pages of a batch show each style, and each text, at each node; of m copies each counts 1 / m."""
    known: dict[str, int] = {}

    def number(text: str) -> int:
        if len(known) > 1 << 18:
            known.clear()
        got = known.get(text)
        if got is None:
            got = known[text] = _hash(text)
        return got

    for batch in batches:
        seen: dict[tuple, int] = {}
        for host, page, copies in zip(batch["host"], batch["html"], batch["copies"]):
            nodes, blocks = parse(page)
            found = set()
            for node in nodes:
                parent = number(node.parent.style) if node.parent is not None else 0
                found.add((host, number(node.style), parent, number(",".join(dict.fromkeys(node.children))), True))
            for node, text in blocks:
                parent = number(node.parent.style) if node.parent is not None else 0
                found.add((host, number(node.style), parent, _hash(text), False))
            for key in found:
                seen[key] = seen.get(key, 0) + 1 / copies
        columns = list(zip(*seen)) if seen else [[]] * 5
        yield pd.DataFrame({"host": list(columns[0]), "node": list(columns[1]), "parent": list(columns[2]),
                            "feature": list(columns[3]), "presentation": list(columns[4]), "n": list(seen.values())})


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html", gamma: float = GAMMA) -> DataFrame:
    """``host, node, pages, style, importance`` of every node of the merged trees.

    Pages of a host whose elements have the same path of names and classes meet
    in one node. With m pages at a node, its presentation importance ``style`` is
    the entropy (base m) of the child sequences seen there, and its content
    importance 1 minus the mean entropy of its texts over the pages that show
    them, log(n) / log(m) for a text on n pages: varied branches carry content,
    repeated ones are furniture. ``importance`` of a node with texts is gamma times
    its content and 1 - gamma times its parent's presentation; null without
    texts. A branch is unimportant when all its nodes with texts are, so those
    decide. Pages of a host with the same html weigh together as one page. Of pages without
    copies only digests and counts are shuffled, added up in each task first.
    """
    read = pages.select(_host(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html"))
    read = read.withColumn("digest", F.xxhash64("html", "host"))
    copies = written(read.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "style-copies")
    counts = read.join(copies, "digest", "left").select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies")) \
        .mapInPandas(_statistics, _STATS).groupBy("host", "node", "parent", "feature", "presentation") \
        .agg(F.round(F.sum("n"), 6).alias("n"))
    counts = written(counts, "style-counts")
    at = ["host", "node", "parent"]
    m = counts.where("presentation").groupBy(*at).agg(F.round(F.sum("n"), 5).alias("pages"))
    log_m = F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    share = F.col("n") / F.col("pages")
    repeated = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log("n") / log_m))
    own = written(counts.join(m, at).groupBy(*at, "pages").agg(
        F.sum(F.when(F.col("presentation"), -share * F.log(share) / log_m)).alias("style"),
        (1 - F.sum(F.when(~F.col("presentation"), F.col("n") * repeated))
         / F.sum(F.when(~F.col("presentation"), F.col("n")))).alias("content")), "style-nodes")
    above = own.select("host", F.col("node").alias("parent"), F.col("style").alias("above"))
    return own.join(above, ["host", "parent"], "left").select(
        "host", "node", "pages", "style",
        (gamma * F.col("content") + (1 - gamma) * F.coalesce("above", F.lit(1.0))).alias("importance"))


def main_blocks(page: str | None, low: set[int]) -> list[str]:
    """Texts of the main blocks: not in a branch that is noise, not in a branch the
    tree found unimportant. Where the page marks its main part only that counts, and
    the tree judges the branches inside it too.

    Classes and ids are a first guess: where they would leave no marked main
    part, or no text that the tree finds important, they do not hold.
    """
    nodes, blocks = parse(page)
    blocks = [(n, t) for n, t in blocks if not n.noise]
    important = [(n, t) for n, t in blocks if _hash(n.style) not in low] if low else blocks
    marks = [n for n in nodes if n.main and not n.noise]
    trusted = bool(marks) and all(n.named for n in marks)
    if marks:
        blocks, important = ([(n, t) for n, t in part if n.main] for part in (blocks, important))
    # where a host's pages are copies of each other nothing is important: then all stays
    for part in (important, blocks):
        kept = [(n, t) for n, t in part if trusted or not n.named]
        if kept:
            return [t for _, t in kept]
        if part is important and low and part:
            return [t for _, t in part]
    return []


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", low: float = LOW,
            least_pages: int = LEAST_PAGES) -> DataFrame:
    """Each row of ``pages`` as ``doc`` with ``main_text``: its main blocks, one a line.

    Null and empty pages have an empty text; a page without a host is judged by
    the tree of all pages without one; repeated rows get the same text; an empty
    table gives no rows. The tree of a host with fewer than ``least_pages`` pages at a
    node removes nothing there.
    """
    tree = style_tree(pages, url_col, html_col)
    # one row per host: the styles of its templates, not its pages
    unimportant = written(tree.where((F.col("pages") >= least_pages) & (F.col("importance") < low))
                          .groupBy("host").agg(F.collect_set("node").alias("low")), "style-low")

    @F.pandas_udf("string")
    def text(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, low in parts:
            yield pd.Series(["\n".join(main_blocks(p, set(x) if x is not None else set())) for p, x in zip(page, low)],
                            dtype=object)

    rows = as_rows(pages, __host=_host(F.col(f"doc.`{url_col}`")))
    joined = rows.join(unimportant.withColumnRenamed("host", "__host"), "__host", "left")
    return joined.select("doc", text(doc_field(html_col), F.col("low")).alias("main_text"))
