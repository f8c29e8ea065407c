"""HTML main text by site style trees (Yi, Liu, Li 2003).

The pages of a host are merged into one tree of element paths.  A node's
composite importance weighs entropies over the pages that have it: presentation
(how its children are laid out) and content (whether the texts below it differ
from page to page).  Texts are the tree's leaves.  Each page then drops branches and
leaves of low importance, within an article or main element too.  Elements that
the page itself marks as boilerplate are dropped by name or role besides, and an
article or main element, where there is one, bounds the text.

Nodes are 64-bit hashes of their path of whole labels (element and its id or
class, digits made equal), so that a row's size does not depend on the depth.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise, session_for

MIN_PAGES = 5  # different pages of a host that a node needs before its importance counts
MIN_IMPORTANCE = 0.25  # of a branch that stays
CONTENT_WEIGHT = 0.9  # of the content below a node, against its presentation
BROADCAST_IDS = 1_000_000  # nodes of low importance (a long each) up to which they are broadcast

_TAG = re.compile(r"<(?:!--(?:.*?--!?>|>|->|.*\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*+(?:\"[^\"]*\"|'[^']*'|)|[\"'])*+)>)", re.S)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article aside blockquote body button caption details div dl fieldset figure footer form header html main nav ol section table td th ul".split())
_SCOPE_NOT_DIV, _BORDERS = _SCOPE - {"div"}, frozenset(("table", "body", "html"))
_DROPPED = frozenset("head script style noscript template iframe object svg math canvas nav footer aside form button select textarea input menu dialog title noembed noframes xmp audio video".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar side rail widget widgets related recommended share sharing social toolbar pagination pager comment comments disqus respond reply replies footer masthead copyright".split()
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[a-z]+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}


def _marked(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element is marked as boilerplate."""
    if tag in _DROPPED or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if attributes.get("role", "").lower() in _ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return any(w in _WORDS for name in names.split() for w in _PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))


@lru_cache(1 << 17)
def node_id(parent: int, label: str) -> int:
    """Hash of a path: of its parent's hash and its last label."""
    return int.from_bytes(hashlib.blake2b(f"{parent}/{label}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class _Stack:
    """Open elements, with what is asked of all of them kept up to date, so that no step depends on the depth."""

    def __init__(self):
        self.tags: list[str] = []
        self.marks: list[bool] = []  # this element or one above is marked
        self.insides: list[int] = []  # steps of the path down to the outermost article or main, and one; 0 without
        self.chain: list[int] = []  # nodes of the labelled elements
        self.lengths: list[int] = []  # of the chain, with this element
        self.blocky: list[bool] = []  # whether closing it ends a block
        self.at: dict[str, list[int]] = {}  # places of the open elements of a tag
        self.scopes: list[int] = []
        self.scopes_not_div: list[int] = []
        self.borders: list[int] = []  # of table, body, html

    def push(self, tag, label, marked, inside):
        k = len(self.tags)
        self.tags.append(tag)
        self.marks.append(marked or bool(k and self.marks[-1]))
        self.blocky.append(tag not in _INLINE or marked)
        if label:
            self.chain.append(node_id(self.chain[-1] if self.chain else 0, label))
        self.lengths.append(len(self.chain))
        above = self.insides[-1] if k else 0
        self.insides.append(above or (len(self.chain) + 1 if inside else 0))
        self.at.setdefault(tag, []).append(k)
        for places, tags in ((self.scopes, _SCOPE), (self.scopes_not_div, _SCOPE_NOT_DIV), (self.borders, _BORDERS)):
            if tag in tags:
                places.append(k)

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def cut(self, k):
        for tag in reversed(self.tags[k:]):
            self.at[tag].pop()
        for places in (self.scopes, self.scopes_not_div, self.borders):
            while places and places[-1] >= k:
                places.pop()
        del self.tags[k:], self.marks[k:], self.insides[k:], self.lengths[k:], self.blocky[k:]
        del self.chain[self.lengths[-1] if self.lengths else 0 :]


def parse(html: str):
    """Blocks of a page in order: (nodes of its path, text, marked as boilerplate, inside article or main).

    Inside is 0 without an article or main element around the block, else one
    more than the steps of its path down to the outermost of them.
    Void, implied-end and raw-text elements are handled as browsers do for
    common pages; end tags without a start are passed over.  References are
    decoded in each run of characters, before tags between runs go.
    """
    stack = _Stack()
    parts: list[str] = []
    blocks: list[tuple[tuple[int, ...], str, bool, int]] = []

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                blocks.append((tuple(stack.chain), text, bool(stack.marks and stack.marks[-1]), stack.insides[-1] if stack.insides else 0))

    def add(text):
        parts.append(entities.unescape(text) if "&" in text else text)

    def pop(k):
        if any(stack.blocky[k:]):
            flush()
        stack.cut(k)

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        if lt > at:
            add(html[at:lt])
        m = _TAG.match(html, lt)
        if not m:
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            places = stack.at.get(tag)
            if places and not (tag in _INLINE and stack.borders and stack.borders[-1] > places[-1]):
                pop(places[-1])
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _INLINE:
            flush()
        if tag in _CLOSES_P or tag in _CLOSES:
            found = stack.last(_CLOSES.get(tag, {"p"}) | ({"p"} if tag in _CLOSES_P else set()))
            scopes = stack.scopes_not_div if tag in ("li", "dt", "dd") else stack.scopes
            if found >= 0 and (not scopes or scopes[-1] <= found):
                pop(found)
        if tag in _VOID:
            continue
        attributes = _attributes(m[3])
        inside = tag in ("article", "main") or attributes.get("role") == "main"
        here = inside or bool(stack.insides and stack.insides[-1])
        if tag in _INLINE:
            label = ""
            marked = bool(attributes) and _marked(tag, attributes, here)
            if marked and not (stack.marks and stack.marks[-1]):
                flush()  # its text is a block of its own, to be dropped alone
        else:
            name = attributes.get("id") or attributes.get("class") or ""
            label = tag + ("." + re.sub(r"\d+", "#", name) if name else "")
            marked = _marked(tag, attributes, here)
        stack.push(tag, label, marked, inside)
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            if tag in ("textarea", "title"):
                add(html[at : end.start() if end else size])
            at = end.start() if end else size
    flush()
    return blocks


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def candidates(html: str) -> list[tuple[tuple[int, ...], str, int]]:
    """(path, text, inside) of the blocks that the style tree decides on: not marked, and inside of article or main if any such block is."""
    blocks = [(path, text, inside) for path, text, marked, inside in parse(html) if not marked]
    return [b for b in blocks if b[2]] or blocks


def style_rows(pages: DataFrame) -> DataFrame:
    """(host, node, kind, value, page): a page's nodes.  Kind 0: the node is there; 1: its layout; 2: a text below it; 3: a text of its own.

    ``page`` is a hash of the page's blocks, the same for copies.  Only blocks that may stay are in the tree, and from an article or main
    element down, where there is one.  Rows leave in pieces of bounded size.
    """

    def over(batch):
        hosts: list[str] = []
        out: list[tuple[int, int, int, int]] = []

        def piece():
            node, kind, value, page = np.array(out, dtype=np.int64).reshape(len(out), 4).T
            rows = {"host": pa.array(hosts, pa.string()), "node": node, "kind": kind.astype(np.int32), "value": value, "page": page}
            hosts.clear(), out.clear()
            return rows

        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            blocks = candidates(page or "")
            own = _hash("\n".join(f"{path[-1:]}\t{text}" for path, text, _ in blocks))
            layout: dict[int, tuple[int, int]] = {}  # hash of the children so far, the last of them
            for path, text, inside in blocks:
                value = _hash(text)
                chain = path[max(0, inside - 2) :] or (0,)
                out.append((chain[-1], 3, value, own))
                for k, node in enumerate(chain):
                    child = chain[k + 1] if k + 1 < len(chain) else 1
                    run, last = layout.get(node, (0, 0))
                    if child != last:
                        layout[node] = (hash((run, child)), child)
                    out.append((node, 2, value, own))
                if len(out) > 100_000:
                    hosts.extend([host] * (len(out) - len(hosts)))
                    yield piece()
            for node, (run, _) in layout.items():
                out += [(node, 0, 0, own), (node, 1, run, own)]
            hosts.extend([host] * (len(out) - len(hosts)))
        if out:
            yield piece()

    return arrow_map(pages.select("host", "html"), over, "host string, node long, kind int, value long, page long")


def counts(rows: DataFrame) -> DataFrame:
    """(host, node, kind, value, n): the different pages of every style row; without a column ``page`` every row is one."""
    n = F.countDistinct("page") if "page" in rows.columns else F.count(F.lit(1))
    return rows.groupBy("host", "node", "kind", "value").agg(n.alias("n"))


def importances(rows: DataFrame) -> DataFrame:
    """(host, node, pages, importance) of the style tree's nodes, from style rows or their counts.

    Content: one minus the mean, over the distinct texts below the node, of the entropy
    of their spread over the m pages that have the node (log_m of the pages
    with the text).  Presentation: entropy of the layouts, base m.  The composite weighs
    content with CONTENT_WEIGHT, presentation with the rest.  Copies of a page count once.  Counts are summed before they are shuffled, so
    a host with a third of all pages is no heavier than its distinct texts.
    """
    counted = rows if "n" in rows.columns else counts(rows)
    n = F.col("n")
    summed = counted.groupBy("host", "node").agg(
        F.max(F.when(F.col("kind") == 0, n)).alias("pages"),
        F.sum(F.when(F.col("kind") == 2, F.log(n.cast("double")))).alias("spread"),
        F.count(F.when(F.col("kind") == 2, True)).alias("texts"),
        F.sum(F.when(F.col("kind") == 1, n * F.log(n.cast("double")))).alias("layout"),
    )
    m = F.log(F.col("pages").cast("double"))
    content = 1 - F.coalesce("spread", F.lit(0.0)) / F.greatest("texts", F.lit(1)) / m
    presentation = (m - F.coalesce("layout", F.lit(0.0)) / F.col("pages")) / m
    composite = CONTENT_WEIGHT * content + (1 - CONTENT_WEIGHT) * presentation
    return summed.select("host", "node", "pages", F.when(F.col("pages") > 1, composite).otherwise(1.0).alias("importance"))


def low_nodes(counted: DataFrame, min_pages: int, min_importance: float) -> DataFrame:
    """(host, node, value) of the nodes of low importance, value null, and of their own texts (leaves) of low importance, by hash.

    A leaf has one text, so its importance is one minus the entropy of that
    text's spread over the pages with the node.  As this falls below any bound
    for a small share of many pages, a leaf also needs more than half of them.
    """
    nodes = importances(counted).where(F.col("pages") >= min_pages)
    n, m = F.col("n"), F.col("pages")
    texts = counted.where((F.col("kind") == 3) & (2 * n > min_pages)).join(nodes.select("host", "node", "pages"), ["host", "node"])
    texts = texts.where((2 * n > m) & (1 - F.log(n.cast("double")) / F.log(m.cast("double")) < min_importance))
    return nodes.where(F.col("importance") < min_importance).select("host", "node", F.lit(None).cast("long").alias("value")).unionByName(texts.select("host", "node", "value"))


def main_text(html: str, low: set, leaves: set = frozenset()) -> str:
    """Main text of a page, given the host's nodes of low importance and its leaves (node, text hash); of an article or main element, only what lies below it is judged."""
    kept = []
    for path, text, inside in candidates(html):
        if low and any(x in low for x in path[max(0, inside - 1) :]):
            continue
        if leaves and ((path or (0,))[-1], _hash(text)) in leaves:
            continue
        kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null and empty pages have an empty text; repeated rows and null ids or urls
    are kept (pages without a host share one tree); text outside of any element
    is a block; other columns are ignored, whatever their names; an empty
    table gives an empty result.

    Scale: pages are parsed where they are read, twice, in time in proportion to
    their length and depth, and never shuffled while the hosts' low nodes and leaves are within ``BROADCAST_IDS`` (counted
    first); beyond, pages are joined with them by host.  What a host has of
    these is in proportion to its template, as each needs ``min_pages`` different pages.
    """
    session_for(pages.sparkSession)
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    low = materialise(low_nodes(materialise(counts(style_rows(rows))), min_pages, min_importance))
    by_host = low.groupBy("host").agg(F.collect_list(F.struct("node", "value")).alias("low"))
    joined = rows.join(F.broadcast(by_host) if low.count() <= BROADCAST_IDS else by_host, "host", "left").select("page_id", "url", "html", F.col("low.node").alias("nodes"), F.col("low.value").alias("values"), "host")

    def over(batch):
        texts = []
        sets: dict = {}  # hosts' low nodes and leaves
        for k, (html, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True)):
            if host not in sets:
                pairs = list(zip(batch.column(3)[k].as_py() or (), batch.column(4)[k].as_py() or (), strict=True))
                sets[host] = ({x for x, v in pairs if v is None}, {p for p in pairs if p[1] is not None})
            texts.append(main_text(html or "", *sets[host]))
        yield {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    return arrow_map(joined, over, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
