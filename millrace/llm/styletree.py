"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree whose nodes are chains of presentation keys (tag with class,
id and role). A node's presentation importance is the entropy of the child sequences that pages show
under it; its content importance is low where the same text stands on many of its pages. A branch's
importance joins its node's presentation with the content of all below it, and one more page on which all
is new, so that few pages say little. Every branch is judged so, and removed from a page where its
importance and the prior of its name together miss the threshold. Names are that prior and no more: a branch that
stands in an article or main element gains a little, one whose tag or class says menu, advert, form or the
like loses much, for the words of a menu or a reader's comment may be new on every page, and one with no name beside
an article loses with the share of the page that the article has.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stored

#: Weight of content in a branch's importance, the importance that a branch needs with its prior, and pages that
#: speak for any branch.
CONTENT_WEIGHT, THRESHOLD, PSEUDO_PAGES = 0.9, 0.2, 1
#: Priors of names: of chrome, of what stands in an article or main element, and of what stands beside a whole page of it.
CHROME_PRIOR, CONTENT_PRIOR, BESIDE_PRIOR = -0.85, 0.1, -2.1
#: Elements further down belong to the branch above them.
DEPTH = 128

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|math|object|select|canvas|audio|video)\b[^>]*(?:(?<=/)>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|([^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag closes an open one of these, as far as the tags named second.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"datalist"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "body": ({"head"}, {"html"}),
}
_KEEPS_P = frozenset("tr td th tbody thead tfoot caption option li dt dd".split())
_CHROME_TAGS = frozenset("head nav footer aside form menu dialog button fieldset label search datalist".split())
_CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead topbar toolbar footer copyright sidebar aside widget widgets related recommended cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup login form search share sharing social comment comments discussion disqus reply replies respond "
    "pagination pager skip".split()
)
#: Words that say of a name only what shape or place its element has: "comment-list" is chrome, "related-work" is not.
_SHAPE_WORDS = frozenset(
    "area bar block bottom box btn button buttons col column container content entry global group inner item items left link links list main outer panel post posts "
    "primary right row secondary section site page slot small large thread title top tools unit user wide wrap wrapper article articles story stories".split()
)
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
_ROOTS = frozenset(("article", "main"))
_NODES = 200_000

_FREE, _CHROME, _CONTENT, _WHOLE = 0, -1, 1, 2
_WHOLE_TAGS = frozenset(("html", "body"))  # the page itself is no branch


def _names_chrome(name: str, in_content: bool) -> bool:
    """Whether one class or id consists of words of chrome and of shape; in content a header is the content's own."""
    words = {w.lower() for w in _WORDS.findall(name)}
    telling = words & _CHROME_WORDS - ({"header"} if in_content else set())
    return bool(telling) and words <= _CHROME_WORDS | _SHAPE_WORDS


class Node:
    """A chain of presentation keys: its hash, the node above and what names say of it."""

    __slots__ = ("tag", "hash", "above", "depth", "named", "kids")

    def __init__(self, tag: str, hash_: int, above: Node | None, named: int) -> None:
        self.tag, self.hash, self.above, self.named = tag, hash_, above, named
        self.depth: int = above.depth + 1 if above else 0
        self.kids: dict[str, Node] = {}

    def chain(self) -> list[int]:
        """The hashes from the top down to the node: at most ``DEPTH``."""
        out, node = [], self
        while node.above is not None:
            if node.depth <= DEPTH:
                out.append(node.hash)
            node = node.above
        return out[::-1]


class Trie:
    """The nodes that a worker has met."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.root, self.size = Node("", 0, None, _FREE), 0

    def child(self, above: Node, tag: str, attributes: str) -> tuple[str, Node]:
        """The key and node of an element; attributes but class, id and role say nothing of presentation."""
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(attributes)} if "=" in attributes else {}
        key = " ".join([tag, *(f"{k}={v}" for k, v in sorted(found.items()))])
        node = above.kids.get(key)
        if node is None:
            chrome = tag in _CHROME_TAGS or found.get("role", "").lower() in _CHROME_ROLES
            if not chrome and tag not in _WHOLE_TAGS | _ROOTS:
                chrome = any(_names_chrome(t, above.named == _CONTENT) for k in ("class", "id") for t in found.get(k, "").split())
            # The header of an article holds its title; elsewhere a header is the page's.
            chrome = chrome or (tag == "header" and above.named != _CONTENT)
            named = _CHROME if chrome or above.named == _CHROME else _CONTENT if tag in _ROOTS or found.get("role", "").lower() == "main" else above.named
            deep = above.depth >= DEPTH
            hash_ = above.hash if deep else xxhash.xxh64_intdigest(key.encode(), above.hash) >> 1
            node = above.kids[key] = Node(tag, hash_, above, above.named if deep else named)
            self.size += 1
        return key, node


class Page:
    """A parsed page: blocks of (node, text) pieces in order, and each node's child sequences."""

    def __init__(self, source: str, trie: Trie) -> None:
        self.blocks: list[list[tuple[Node, str]]] = [[]]
        self.shapes: dict[Node, int] = {}
        self._stack: list[list] = [[trie.root, 0, ""]]  # node, hash of child keys, last key
        self._open: dict[str, list[int]] = {}  # places of open elements in the stack, by tag
        self._holders: set[Node] | None = None
        self._trie = trie
        for m in _TOKEN.finditer(source):
            text = m[8]
            if text is not None:
                self.blocks[-1].append((self._stack[-1][0], html_lib.unescape(text) if "&" in text else text))
            elif m[3] or m[6]:
                tag = (m[3] or m[6]).lower()
                if m[2] or m[5]:
                    self._end(tag)
                elif m[3] or m[0].endswith(">"):  # a tag that the page's end cuts says nothing
                    self._start(tag, m[4] or m[7] or "")
        while len(self._stack) > 1:
            self._pop()

    def _pop(self) -> None:
        node, shape, _ = self._stack.pop()
        self._open[node.tag].pop()
        self.shapes[node] = self.shapes.get(node, 0) ^ shape
        if node.tag in _BLOCK:
            self._cut()

    def _cut(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def _last(self, tags: set[str]) -> int:
        return max([self._open[t][-1] for t in tags if self._open.get(t)], default=0)

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """End the innermost open one of ``tags`` unless one of ``stop`` stands inside it."""
        at = self._last(tags)
        if at and at > self._last(stop):
            while len(self._stack) > at:
                self._pop()

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _BLOCK and tag not in _KEEPS_P:
            self._close({"p"}, {"table", "td", "th", "button", "caption"})
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if tag == "br":
            self.blocks[-1].append((self._stack[-1][0], " "))
        if tag in _BLOCK:
            self._cut()
        above = self._stack[-1]
        key, node = self._trie.child(above[0], tag, attributes)
        if key != above[2]:
            above[1] = (above[1] * 1_000_003 + node.hash) & 0x7FFFFFFFFFFFFFFF
            above[2] = key
        if tag not in _VOID:
            self._open.setdefault(tag, []).append(len(self._stack))
            self._stack.append([node, 0, ""])

    def _end(self, tag: str) -> None:
        self._close({tag}, set())

    def text(self, importance: dict[int, float] | None = None) -> str:
        """The blocks that stay, each with its white space made one space, joined by one space.

        ``importance`` is that of the page's branches, by hash; a branch that it lacks is wholly important.
        """
        importance = importance or {}
        shares = {_CONTENT: 0, _FREE: 0, _CHROME: 0}
        for block in self.blocks:
            for node, piece in block:
                shares[node.named] += len(piece) - piece.count(" ") if not piece.isspace() else 0
        beside = BESIDE_PRIOR * shares[_CONTENT] / max(1, shares[_CONTENT] + shares[_FREE])
        prior = {_CONTENT: CONTENT_PRIOR, _FREE: beside, _CHROME: CHROME_PRIOR}
        fate: dict[Node, bool] = {}

        def stays(node: Node) -> bool:
            path = []
            while node.above is not None and node not in fate:
                path.append(node)
                node = node.above
            good = fate.get(node, True)
            for n in reversed(path):
                if n.tag not in _WHOLE_TAGS:  # what holds an article is not beside it
                    good = good and importance.get(n.hash, 1.0) + (0.0 if n.named == _FREE and self._holds(n) else prior[n.named]) >= THRESHOLD
                fate[n] = good
            return good

        kept = [[p for p in b if stays(p[0])] for b in self.blocks]
        if importance and not any(not p[1].isspace() for b in kept for p in b):
            return self.text()  # a page of unimportant branches only keeps what names leave
        blocks = [" ".join("".join([t for _, t in b]).split()) for b in kept]
        return " ".join([b for b in blocks if b])

    def _holds(self, node: Node) -> bool:
        """Whether an article or main element stands in the node."""
        if self._holders is None:
            self._holders = set()
            for n in self.shapes:
                if n.named == _CONTENT:
                    up = n.above
                    while up is not None and up not in self._holders:
                        self._holders.add(up)
                        up = up.above
        return node in self._holders


_TRIE = Trie()


def _parsed(source: str | None) -> Page:
    if _TRIE.size > _NODES:
        _TRIE.forget()
    return Page(source or "", _TRIE)


_NODE_SCHEMA = "page long, host string, node long, chain array<long>, named int, shape long, texts array<long>"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    names = [c.split()[0] for c in _NODE_SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for key, host, source in zip(*[c.to_pylist() for c in batch.columns]):
            page = _parsed(source)
            texts: dict[int, set[int]] = {}
            for block in page.blocks:
                for node, piece in block:
                    if flat := " ".join(piece.split()):
                        texts.setdefault(node.hash, set()).add(xxhash.xxh64_intdigest(flat) >> 1)
            for n, shape in page.shapes.items():
                if n.depth <= DEPTH:
                    rows.append((key, host, n.hash, n.chain(), _WHOLE if n.tag in _WHOLE_TAGS else n.named, shape & 0x7FFFFFFFFFFFFFFF, list(texts.get(n.hash, ()))))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)


def host_of(url) -> F.Column:
    """The host of a URL in lower case, without user or port; empty where there is none."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), r"^.*@|:\d*$", ""))


def node_importance(nodes: DataFrame, pseudo_pages: float = 0) -> DataFrame:
    """(host, node, named, pages, importance) of every node of every host's style tree.

    ``pseudo_pages`` are further pages on which a branch is wholly important.

    ``nodes`` has one row for each distinct page and node. The sums are over all pages of a host, by partial
    aggregation, so a host with a third of all pages is spread over tasks like any other.
    """
    per = nodes.groupBy("host", "node").agg(F.count("*").alias("pages"), F.first("chain").alias("chain"), F.first("named").alias("named"))
    shapes = nodes.groupBy("host", "node", "shape").agg(F.count("*").alias("n"))
    shown = shapes.groupBy("host", "node").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    said = nodes.select("host", "node", F.explode("texts").alias("t")).groupBy("host", "node", "t").agg(F.count("*").alias("n"))
    told = said.groupBy("host", "node").agg(F.sum("n").alias("texts"), F.sum(F.col("n") * F.log("n")).alias("tlogt"))
    tree = per.join(shown, ["host", "node"]).join(told, ["host", "node"], "left")
    # Entropy to the base of the number of pages: -sum p log p = log N - (sum n log n) / N.
    tree = tree.select(
        "host", "node", "chain", "named", "pages", F.coalesce("texts", F.lit(0)).alias("texts"),
        F.when(F.col("pages") > 1, (F.log("total") - F.col("nlogn") / F.col("total")) / F.log("pages")).otherwise(1.0).alias("presentation"),
        F.when((F.col("pages") > 1) & (F.col("texts") > 0), F.col("texts") - F.col("tlogt") / F.log("pages")).otherwise(F.coalesce("texts", F.lit(0))).alias("content"),
    )
    below = tree.select("host", F.explode("chain").alias("node"), "texts", "content").groupBy("host", "node").agg(F.sum("texts").alias("below"), F.sum("content").alias("content"))
    weight, smoothed = F.lit(CONTENT_WEIGHT), lambda x: (x * F.col("pages") + pseudo_pages) / (F.col("pages") + pseudo_pages)
    mean = F.when(F.col("below") > 0, F.greatest(F.lit(0.0), F.col("content") / F.col("below"))).otherwise(0.0)
    return tree.drop("content").join(below, ["host", "node"]).select("host", "node", "named", "pages", smoothed((1 - weight) * F.col("presentation") + weight * mean).alias("importance"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", pseudo_pages: float = PSEUDO_PAGES) -> DataFrame:
    """One row per input row: the id, the url, ``text`` and ``n_chars`` (its code points).

    Null html counts as empty and gives an empty text; null urls share one host. Equal rows are all kept;
    exact copies of a page count once in the style tree. A page all of whose branches are unimportant
    keeps those that names leave. An empty table gives an empty result. Other columns are not read. Elements more
    than ``DEPTH`` deep belong to the branch above them; their text is treated like any other.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("page", F.xxhash64("host", "html"))
    nodes = stored(rows.select("page", "host", "html").mapInArrow(_nodes, _NODE_SCHEMA).dropDuplicates(["page", "node"]), "style-nodes")
    # Importances that can change a branch's fate: the prior of chrome alone outweighs the highest.
    matters = (F.col("named") == _FREE) | (F.col("named") == _CONTENT) & (F.col("importance") < THRESHOLD - CONTENT_PRIOR)
    known = node_importance(nodes, pseudo_pages).where(matters).select("host", "node", "importance")
    known = stored(known, "style-importance")  # a node on all pages of a hot host meets it: Spark can broadcast this side or split the other
    judged = nodes.where(F.col("named").isin(_FREE, _CONTENT)).select("page", "host", "node").join(known, ["host", "node"])
    judged = judged.groupBy("page").agg(F.collect_list(F.struct("node", "importance")).alias("found"))
    judged = stored(judged.select("page", "found.node", "found.importance"), "style-judged")  # of known size: where it is small, Spark broadcasts it and no page is shuffled
    given = rows.join(judged, "page", "left").select("id", "url", "node", "importance", "html")
    kind = given.schema["id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_parsed(h).text(dict(zip(n or (), i or ()))) for n, i, h in zip(*[batch.column(c).to_pylist() for c in (2, 3, 4)])]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    return given.mapInArrow(extract, f"id {kind}, url string, text string, n_chars long").toDF(id_col, url_col, "text", "n_chars")


def page_text(source: str) -> str:
    """The main text of one page by names alone."""
    return _parsed(source).text()
