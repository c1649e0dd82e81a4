"""Main text of web pages by wrapper induction.

Pages of one host come from few templates. The DOM trees of a host's pages are
folded into one wrapper by simple tree matching (Yang, 1991): roots with the same
key (tag, class and id, role) match, and the children of matching nodes are
aligned in order so that the number of matching nodes is largest. A wrapper node
knows how many pages have it, whether its text was always the same, how much text
it held and how much of that in links.

Constant nodes become template, varying slots become content:

1. A node whose text was the same on ``MIN_PAGES`` different pages or more, and on
   a share of ``CONSTANT_SHARE`` of the host's pages, is template. On a page it is
   dropped only where its text is that text.
2. Varying slots with text outside links name the region: the lowest node
   of the wrapper that holds all of them. Everything below it that is no template
   is content, short slots too.
3. Kinds that no article has (menus, forms, notices and the like by tag, role or
   class) are no slots and never content. They and ``article`` or ``main`` break
   ties: where the region has articles that hold most of its text, the slots
   beside them are left out. A list of links counts as a menu where the region is
   the whole body.

A host with fewer than ``MIN_PAGES`` different pages shows no constancy: its pages
give their articles, else their main elements, else their bodies, by rule 3 alone.

Scale. The wrappers of single pages, compressed, meet by host and digest of the
html, where copies become one. They are folded in the tasks that hold them then,
so a host with a third of all pages gives one small tree a batch; these are
folded in two steps, salted first. Folding is lossy counting: every
``1 / RARE_SHARE`` pages the nodes go that no more than this share of the pages
can have had. So a share is known to within ``RARE_SHARE``, nodes near
``CONSTANT_SHARE`` stay whatever the order of pages, and a wrapper's size follows
a page's and the logarithm of their number. Pages meet their host's wrapper in a
shuffle join that AQE can split; pages of hosts without evidence carry none. Each
page is parsed twice. What lies more than ``DEPTH`` levels down is counted in the
node at that depth, with all its text.

Defined cases: a null html is an empty page with empty text; a null url or one
without host belongs to the host ""; copies of a page count once for constancy;
repeated rows each give their row; an empty table gives no rows; columns of other
names are ignored, whatever they are called; of alignments with equally many
nodes the one that skips nodes of the wrapper last is taken; a page of any length
is read whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_dom import BLOCK, Node, parse

#: A node is template if its text is the same on at least so many different pages and on this share of them.
MIN_PAGES, CONSTANT_SHARE = 5, 0.8
#: Nodes that no larger share of a host's pages can have are dropped from its wrapper.
RARE_SHARE = 0.02
DEPTH = 40
MAX_LINK_SHARE = 0.6
#: Characters a page, outside links, that make a varying slot one of text.
PROSE_CHARS = 3
_SALT = 64

# Elements and names that never belong to an article.
EXCLUDED_TAGS = frozenset(
    "head script style noscript template nav footer aside form button select input textarea iframe object embed svg canvas audio video menu dialog search title".split()
)
EXCLUDED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
EXCLUDED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login"
    r"|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-?bar|widget\w*|related|recommend\w*|share|sharing|social|footer|header|masthead|topbar|comments?|comment-?list|replies|disqus|respond|pagination|pager|tags?|toc|skip-?link)(?:$|[\s_-])"
)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_HEADINGS = frozenset(("h1", "h2"))


def excluded(tag: str, names: str, role: str, in_article: bool) -> bool:
    if tag in EXCLUDED_TAGS or role in EXCLUDED_ROLES:
        return True
    if tag == "header" and not in_article:
        return True
    return bool(names) and tag not in ("body", "html", "article", "main") and bool(EXCLUDED_NAMES.search(names))


def _skips(in_article: bool) -> Callable[[Node], bool]:
    return lambda x: excluded(x.tag, x.names, x.role, in_article)


def blocks(node: Node, skip: Callable[[Node], bool] | None = None) -> list[str]:
    """Texts of the blocks below a node in page order, white space made one space."""
    out, line = [], []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip(" ")
        if text:
            out.append(text)
        line.clear()

    stack: list = [iter([node])]
    open_: list[bool] = []
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            if open_ and open_.pop():
                flush()
        elif isinstance(x, str):
            line.append(x)
        elif skip and x is not node and skip(x):
            if x.tag in BLOCK:
                flush()
        elif x.tag == "br":
            line.append(" ")
        else:
            block = x.tag in BLOCK
            if block:
                flush()
            stack.append(iter(x.items))
            open_.append(block)
    flush()
    return out


# A wrapper node: [key, pages, hash of its text or "" if it varies, chars, link chars, pages it may have had before
# it was dropped, children]. The key is tag, names and role; chars and hash cover the whole subtree.
_KEY, _PAGES, _HASH, _CHARS, _LINKS, _LOST, _KIDS = range(7)


def _inner(node: Node) -> tuple[str, int]:
    """All text below a node that is in no script or style, and how much of it is in links."""
    texts, links = [], 0
    stack: list = [(node, node.tag == "a")]
    while stack:
        x, in_link = stack.pop()
        if isinstance(x, str):
            texts.append(x)
            links += len(x) * in_link
        elif x is node or x.tag not in ("script", "style", "head"):
            stack.extend((y, in_link or (not isinstance(y, str) and y.tag == "a")) for y in reversed(x.items))
    return "\n".join(texts), links


def _digest(texts: str) -> str:
    return hashlib.md5(texts.encode("utf-8", "replace")).hexdigest()[:12]


def sketch(node: Node, at: dict[int, list[Node]] | None = None, depth: int = 0) -> list:
    """The wrapper of one page; neighbours of one key are one node. at: the page's nodes by id() of their wrapper node."""
    if depth >= DEPTH:
        text, links = _inner(node)
        out = [node.key, 1, _digest(text), len(text), links, 0, []]
    else:
        own = [x for x in node.items if isinstance(x, str)]
        kids: list[list] = []
        for x in node.items:
            if isinstance(x, str) or x.tag in ("script", "style", "head"):
                continue
            s = sketch(x, at, depth + 1)
            if kids and kids[-1][_KEY] == s[_KEY]:
                kids[-1] = _run(kids[-1], s, at, {})
            else:
                kids.append(s)
        chars = sum(map(len, own)) + sum(k[_CHARS] for k in kids)
        links = chars if node.tag == "a" else sum(k[_LINKS] for k in kids)
        out = [node.key, 1, _digest("\n".join(own) + "\0" + "\0".join(k[_HASH] for k in kids)), chars, links, 0, kids]
    if at is not None:
        at[id(out)] = [node]
    return out


def _align(a: list[list], b: list[list], known: dict) -> list[tuple[int, int]]:
    """Ordered pairs of children that match, the most nodes in all."""
    ka, kb = [x[_KEY] for x in a], [x[_KEY] for x in b]
    if ka == kb and len(set(ka)) == len(ka):
        return [(k, k) for k in range(len(a))]
    places: dict[str, list[int]] = {}
    for j, k in enumerate(kb):
        places.setdefault(k, []).append(j)
    if not any(k in places for k in ka):
        return []
    # best[i][j]: the most nodes that a[i:] and b[j:] can match; along a row a maximum from the right
    best = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int64)
    gain: dict[tuple[int, int], int] = {}
    for i in range(len(a) - 1, -1, -1):
        row = best[i + 1].copy()
        for j in places.get(ka[i], ()):
            gain[i, j] = matching(a[i], b[j], known)
            row[j] = max(row[j], best[i + 1, j + 1] + gain[i, j])
        best[i] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if (i, j) in gain and best[i, j] == best[i + 1, j + 1] + gain[i, j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i, j] == best[i + 1, j]:
            i += 1
        else:
            j += 1
    return out


def matching(a: list, b: list, known: dict | None = None) -> int:
    """Simple tree matching: the number of pairs in the largest top-down ordered matching."""
    if a[_KEY] != b[_KEY]:
        return 0
    if not a[_KIDS] or not b[_KIDS]:
        return 1
    known = {} if known is None else known
    pair = id(a), id(b)
    if pair not in known:
        known[pair] = 1 + sum(matching(a[_KIDS][i], b[_KIDS][j], known) for i, j in _align(a[_KIDS], b[_KIDS], known))
    return known[pair]


def _aligned(a: list, b: list, known: dict) -> Iterator[tuple[list | None, list | None]]:
    """The children of both in order: pairs that match, and single ones."""
    i = j = 0
    for x, y in [*_align(a[_KIDS], b[_KIDS], known), (len(a[_KIDS]), len(b[_KIDS]))]:
        yield from ((k, None) for k in a[_KIDS][i:x])
        yield from ((None, k) for k in b[_KIDS][j:y])
        if x < len(a[_KIDS]):
            yield a[_KIDS][x], b[_KIDS][y]
        i, j = x + 1, y + 1


def _run(a: list, b: list, at: dict[int, list[Node]] | None, known: dict) -> list:
    """Neighbours on one page as one node, with the texts of both."""
    kids = [_run(x, y, at, known) if x and y else x or y for x, y in _aligned(a, b, known)]
    out = [a[_KEY], 1, _digest(a[_HASH] + b[_HASH]), a[_CHARS] + b[_CHARS], a[_LINKS] + b[_LINKS], 0, kids]
    if at is not None:
        at[id(out)] = at.pop(id(a)) + at.pop(id(b))
    return out


def _late(w: list, lost: int) -> list:
    return [*w[:_LOST], w[_LOST] + lost, [_late(k, lost) for k in w[_KIDS]]] if lost else w


def merge(a: list, b: list, lost_a: int = 0, lost_b: int = 0, known: dict | None = None) -> list:
    """The wrapper of both: aligned children are merged, the others kept in order.

    lost_a, lost_b: on how many pages of a and b a node that is not there may have been.
    """
    known = {} if known is None else known
    kids = [merge(x, y, lost_a, lost_b, known) if x and y else _late(x, lost_b) if x else _late(y, lost_a) for x, y in _aligned(a, b, known)]
    same = a[_HASH] if a[_HASH] == b[_HASH] else ""
    return [a[_KEY], *(a[_PAGES] + b[_PAGES], same, a[_CHARS] + b[_CHARS], a[_LINKS] + b[_LINKS], a[_LOST] + b[_LOST]), kids]


def _pruned(w: list, least: int) -> list:
    return [*w[:_KIDS], [_pruned(k, least) for k in w[_KIDS] if k[_PAGES] + k[_LOST] > least]]


class Fold:
    """Wrappers of a host merged one after the other, by lossy counting: every 1 / RARE_SHARE pages the rare nodes go."""

    def __init__(self):
        self.tree, self.lost, self.fresh = None, 0, 0

    def add(self, tree: list, lost: int = 0, fresh: int = 1) -> None:
        self.tree = tree if self.tree is None else merge(self.tree, tree, self.lost, lost)
        self.lost, self.fresh = self.lost + lost, self.fresh + fresh
        if self.fresh * RARE_SHARE >= 1:
            self.lost, self.fresh = int(self.tree[_PAGES] * RARE_SHARE), 0
            self.tree = _pruned(self.tree, self.lost)

    def dump(self) -> bytes:
        return zlib.compress(json.dumps([self.tree, self.lost, self.fresh]).encode())

    def add_dump(self, blob: bytes) -> None:
        self.add(*json.loads(zlib.decompress(blob)))


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per page with html, copies in the batch once: host, digest of the html, wrapper."""
    for batch in batches:
        rows: dict[tuple[str, bytes], bytes] = {}
        for host, html in zip(batch["host"], batch["html"], strict=True):
            mark = (host, hashlib.md5((html or "").encode("utf-8", "replace")).digest())
            if html and mark not in rows:
                one = Fold()
                one.add(sketch(parse(html)))
                rows[mark] = one.dump()
        yield pd.DataFrame([(*k, w) for k, w in rows.items()], columns=["host", "mark", "sketch"], dtype=object)


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found: dict[str, Fold] = {}
        for host, blob in zip(batch["host"], batch["sketch"], strict=True):
            found.setdefault(host, Fold()).add_dump(blob)
        rows = [(h, w.dump()) for h, w in sorted(found.items())]
        yield pd.DataFrame(rows, columns=["host", "wrapper"], dtype=object)


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    out = Fold()
    for blob in sorted(pdf["wrapper"]):
        out.add_dump(blob)
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [out.dump()], "n_pages": [out.tree[_PAGES]]})


def induce(pages: DataFrame) -> DataFrame:
    """(host, wrapper, n_pages) over all pages(host, html); n_pages counts different pages."""
    kind = "host string, wrapper binary"
    sketches = pages.select("host", "html").mapInPandas(_sketches, "host string, mark binary, sketch binary")
    part = sketches.groupBy("host", "mark").agg(F.first("sketch").alias("sketch")).select("host", "sketch").mapInPandas(_partial, kind)
    part = part.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(_SALT)).alias("salt")).applyInPandas(_fold, f"{kind}, n_pages long")
    return part.select("host", "wrapper").groupBy("host").applyInPandas(_fold, f"{kind}, n_pages long")


def _top(nodes: list[Node], wanted: Callable[[Node], bool]) -> list[Node]:
    """The wanted nodes in page order that lie in no other wanted node and in no excluded part."""
    out, stack, skip = [], list(reversed(nodes)), _skips(False)
    while stack:
        x = stack.pop()
        if wanted(x):
            out.append(x)
        elif not skip(x):
            stack.extend(reversed(x.children))
    return out


def _articles(nodes: list[Node]) -> list[Node]:
    return _top(nodes, lambda x: x.tag == "article") or _top(nodes, lambda x: x.tag == "main" or x.role == "main")


def _is_page(node: Node) -> bool:
    return node.tag in ("#document", "html", "body")


class Wrapper:
    """A host's wrapper, applied to one page at a time. Without one, articles and excluded kinds decide."""

    def __init__(self, blob: bytes | None):
        self.tree = json.loads(zlib.decompress(blob))[0] if blob is not None else None
        self.region = None
        if self.tree and self.tree[_PAGES] < MIN_PAGES:
            self.tree = None
        if self.tree:
            found = self._holding(self.tree, False)
            self.region = found if isinstance(found, list) else None

    def _constant(self, w: list) -> bool:
        return bool(w[_HASH] and w[_CHARS] and w[_PAGES] >= MIN_PAGES and w[_PAGES] + w[_LOST] >= CONSTANT_SHARE * self.tree[_PAGES])

    def _holding(self, w: list, in_article: bool) -> list | bool:
        """The lowest node that holds all slots of prose below w; True if w is such a slot itself, False if there is none."""
        tag, names, role = (w[_KEY] + "||").split("|")[:3]
        if excluded(tag, names, role, in_article) or tag == "a" or self._constant(w):
            return False
        in_article = in_article or tag in ("article", "main")
        found = [x for k in w[_KIDS] if (x := self._holding(k, in_article))]
        if found:
            return w if len(found) > 1 or found[0] is True else found[0]
        prose = w[_CHARS] - w[_LINKS]
        return not w[_HASH] and (tag in _HEADINGS or tag in BLOCK and prose >= PROSE_CHARS * w[_PAGES])

    def _matched(self, root: Node) -> tuple[set[int], list[Node]]:
        """The page's template nodes, by id(), and its nodes at the wrapper's region."""
        template: set[int] = set()
        regions: list[Node] = []
        at: dict[int, list[Node]] = {}
        todo = [(sketch(root, at), self.tree)]
        while todo:
            s, w = todo.pop()
            nodes = at[id(s)]
            if self._constant(w) and s[_HASH] == w[_HASH]:
                template.update(map(id, nodes))
                continue
            if w is self.region:
                regions = nodes
            todo.extend((x, y) for x, y in _aligned(s, w, {}) if x and y)
        return template, regions

    def text(self, html: str | None) -> str:
        root = parse(html or "")
        template, regions = self._matched(root) if self.tree else (set(), [])
        length = lambda nodes, inside: sum(len(t) for x in nodes for t in blocks(x, _skips(inside)))
        if regions and not all(x.tag in ("article", "main") for x in regions):
            inner = _articles(regions)
            if inner and 2 * length(inner, True) >= length(regions, True):
                regions = inner
        regions = regions or _articles([root]) or [root]
        inside = not any(map(_is_page, regions))
        skip = _skips(inside)

        def left_out(x: Node) -> bool:
            return id(x) in template or skip(x) or (not inside and _is_menu(x))

        return " ".join(t for x in regions if id(x) not in template for t in blocks(x, left_out))


def _is_menu(node: Node) -> bool:
    """A block whose text is for the most part in links, several of them."""
    if node.tag not in BLOCK or _is_page(node) or sum(x.tag == "a" or any(y.tag == "a" for y in x.children) for x in node.children) < 2:
        return False
    text, links = _inner(node)
    return links > MAX_LINK_SHARE * len(text)


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as (page_id, url, text, n_chars)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    evident = induce(rows).where(F.col("n_pages") >= MIN_PAGES).select("host", "wrapper")
    joined = rows.join(evident.hint("merge"), "host", "left").select("page_id", "url", "html", "wrapper")

    @F.pandas_udf("string")
    def main_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        wrappers: dict[bytes | None, Wrapper] = {}
        for html, wrapper in batches:
            out = []
            for h, w in zip(html, wrapper, strict=True):
                if w not in wrappers:
                    if len(wrappers) > 200:
                        wrappers.clear()
                    wrappers[w] = Wrapper(w)
                out.append(wrappers[w].text(h))
            yield pd.Series(out, dtype=object)

    text = joined.withColumn("text", main_text("html", "wrapper"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
