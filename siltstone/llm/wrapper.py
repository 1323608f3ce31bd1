"""Main text of web pages by wrapper induction.

Up to REFERENCES pages of a host that show text (the least hash of each of so many classes) are its references. Every page is
aligned with the reference whose paths of tags are most like its own, by simple tree matching: two nodes of one tag match, and
their children match in order for the greatest total. Over all distinct pages of a host the alignment tells

* which text nodes of the reference stay constant: they recur with the same text on at least half of the pages (SUPPORT at
  least). They are template, and a page's block is left out if it is aligned with one *and has its text*;
* where text varies: per element, the characters outside links that differ from the reference. The deepest element that holds
  REGION of all varying text, with the article or main part around it or the headings before it, is the host's content region.

A page's main text are the blocks of the element aligned with that region. Pages that repeat most of a reference's main part
(most of its text where an article is marked, most of its blocks where none is) are copies of it and give no evidence, so that
a shared article does not become template.

Markup and names only break ties. Inside the region, elements whose tag says that they are no content (``nav``, ``aside``,
``form``, ``footer``...), hidden ones and those of unmistakable names (adverts, comments, menus, sharing) are left out. Outside
of marked articles further names count (such as banner, search, alert). An element around an article with most of the page's
text is never left out for its name, and names do not count where they would leave nothing. A page without a host's region (too few pages, another structure) takes its largest marked article
or main part, or else all blocks but those and lists of links.

Blocks are runs of text between the borders of block elements; ``<br>`` and inline elements do not end a block. Character
references are decoded, white space becomes one space, blocks are joined by a newline in page order.

What travels between pages are skeletons of the references (tags, text hashes, lengths) with the counts of their nodes. They
are broadcast if together they stay under BROADCAST_BYTES and joined by host otherwise; counts are partial aggregates, so
a host with a third of all pages is spread over all tasks.

Matching is exact at every size: children are aligned by dynamic programming in linear memory beyond CELLS (time stays the
product of both lists' lengths), and no step recurses with the depth of the tree.

Cases: a null or empty html, or one without content, gives the empty text. Broken and cut-off markup is closed as browsers
close it. A null url belongs to the host without a name. Repeated rows and ids each keep their row. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from siltstone.llm.common import cut, scratch

BROADCAST_BYTES = 8 << 20
#: Reference pages a host at most.
REFERENCES = 3
#: Pages, the reference among them, that must agree on a constant node, and their least share of all pages of the reference.
SUPPORT, SHARE = 3, 0.5
#: Least share of the varying text that the content region holds.
REGION = 0.6
#: Cells of an alignment table held at once.
CELLS = 1 << 20

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_HEADS = re.compile(r"\b(?:class|id|role)\s*=\s*[\"']?[^\"'>]*(?<![a-z])(?:header|masthead)(?![a-z])", re.I)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/?>)|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is not markup, or never shown as text.
_RAW = frozenset("script style noscript template iframe textarea title svg object video audio canvas select xmp noembed noframes".split())
_DROP_TAGS = frozenset("nav aside form footer menu dialog search button".split())
#: Names that say everywhere that an element is no content, and names that say so outside of articles only.
_STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos sidebar sidebars menu menus nav navbar navigation"
    " breadcrumb breadcrumbs comment comments commentlist disqus cookie cookies consent gdpr newsletter subscribe subscription share sharing related contentinfo complementary".split()
)
_WEAK = frozenset(
    "promotion banner footer reply replies respond discussion notice notices popup modal overlay signup login social recommended widget widgets toolbar pagination pager form search alert".split()
)
NONE, WEAK, STRONG, HARD = range(4)
_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW}
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"optgroup"})}
_HEADINGS = frozenset("h1 h2 h3 hgroup header".split())


class Node:
    """A block element, or a run of text (tag ``#``). A leaf has a hash and the length of its text, ``linked`` of it in links."""

    __slots__ = ("drop", "free", "hash", "head", "kids", "length", "linked", "number", "same", "seen", "tag", "text", "up")

    def __init__(self, tag: str, drop: int = NONE, head: bool = False) -> None:
        self.tag, self.drop, self.head, self.kids = tag, drop, head, []
        self.text, self.hash, self.length, self.linked, self.number, self.up = None, None, 0, 0, -1, None
        self.free, self.seen, self.same = 0, 0, 0


def _named(tag: str, attributes: str) -> int:
    if tag in _DROP_TAGS:
        return HARD
    if ("hidden" in attributes or "display" in attributes) and _UNSEEN.search(attributes):
        return HARD
    found = NONE
    if "=" in attributes:
        for m in _NAMES.finditer(attributes):
            names = _SPLIT.split((m[1] or m[2] or m[3] or "").lower())
            if not _STRONG.isdisjoint(names):
                return STRONG
            if not _WEAK.isdisjoint(names):
                found = WEAK
    return found


def parse(source: str) -> Node:
    """The tree of block elements and text runs."""
    root = Node("html")
    stack, run, linked, link, skip = [root], [], 0, False, []
    at, n = 0, len(source)

    def flush() -> None:
        nonlocal run, linked
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                leaf = Node("#")
                leaf.text, leaf.length, leaf.linked, leaf.hash = text, len(text), min(linked, len(text)), xxh64_intdigest(text.encode("utf-8", "replace"))
                stack[-1].kids.append(leaf)
            run, linked = [], 0

    while at < n:
        m = _TAG.search(source, at)
        stop = m.start() if m else n
        if stop > at and not skip:
            run.append(source[at:stop])
            linked += (stop - at) * link
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        closing, tag, rest = m[1], m[2].lower(), m[3]
        if tag in _RAW:
            if not closing and not rest.endswith("/>"):
                end = _END[tag].search(source, at)
                at = end.end() if end else n
        elif tag not in _BLOCKS:
            if tag == "br" or tag == "img":
                if not skip:
                    run.append(" ")
            elif skip:
                # inside an inline element that is no content
                if tag == skip[0]:
                    skip = [] if closing and len(skip) == 1 else skip[1:] if closing else [*skip, tag]
            elif tag == "a":
                link = not closing
            elif not closing and not rest.endswith("/>") and _named(tag, rest) >= STRONG:
                skip = [tag]
        elif closing:
            flush()
            skip, link = [], False
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
        else:
            flush()
            skip, link = [], False
            if stack[-1].tag == "p":
                stack.pop()
            if tag in _CLOSES:
                ends, scope = _CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in scope:
                        break
                    if stack[i].tag in ends:
                        del stack[i:]
                        if stack[-1].tag not in ends:
                            break
            if tag in ("html", "body"):
                continue
            node = Node(tag, _named(tag, rest), tag == "header" or "head" in rest and bool(_HEADS.search(rest)))
            stack[-1].kids.append(node)
            if tag != "hr":
                stack.append(node)
    flush()
    return _finished(root)


def _finished(root: Node) -> Node:
    """Number the nodes, name their parents, and hash whole elements. A block whose only child is a text run becomes a leaf itself."""
    for node in walk(root):
        if len(node.kids) == 1 and node.kids[0].tag == "#" and node.tag != "html":
            leaf = node.kids[0]
            node.text, node.hash, node.length, node.linked, node.kids = leaf.text, leaf.hash, leaf.length, leaf.linked, []
    nodes = list(walk(root))
    for i, node in enumerate(nodes):
        node.number = i
        for kid in node.kids:
            kid.up = node
    for node in reversed(nodes):
        if node.hash is None:
            node.hash = xxh64_intdigest(repr((node.tag, [(k.tag, k.hash) for k in node.kids])))
            node.length, node.linked = sum(k.length for k in node.kids), sum(k.linked for k in node.kids)
    return root


def walk(root: Node) -> Iterator[Node]:
    """Nodes in page order."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(node.kids))


def _leaf(node: Node) -> bool:
    """Whether it holds text itself; an element without anything in it does not."""
    return not node.kids and node.length > 0


def skeleton(root: Node) -> str:
    """A tree without its texts: its paths of tags, and its nodes in page order."""
    depth = {id(root): 0}
    rows = []
    for node in walk(root):
        d = depth[id(node)]
        for kid in node.kids:
            depth[id(kid)] = d + 1
        rows.append([d, node.tag, node.hash, node.length, node.linked, node.drop, int(node.head)])
    return json.dumps([sorted(_paths(root)), json.dumps(rows, separators=(",", ":"))], separators=(",", ":"))


def unpack(packed: str) -> Node:
    path: list[Node] = []
    for i, (depth, tag, digest, length, linked, drop, head) in enumerate(json.loads(json.loads(packed)[1])):
        node = Node(tag, drop, bool(head))
        node.hash, node.length, node.linked, node.number = digest, length, linked, i
        del path[depth:]
        if path:
            path[-1].kids.append(node)
            node.up = path[-1]
        path.append(node)
    return path[0]


# --- simple tree matching ---------------------------------------------------------------------------------------------


def _weights(x: list[Node], y: list[Node], known: dict[tuple[int, int], int]) -> Iterator[np.ndarray]:
    """For each node of x what a match with each node of y is worth, 0 for another tag; equal leaves count double."""
    tags = [n.tag for n in y]
    places: dict[tuple[str, int], list[int]] = {}
    for j, n in enumerate(y):
        if _leaf(n):
            places.setdefault((n.tag, n.hash), []).append(j)
    inner = [(j, n) for j, n in enumerate(y) if n.kids]
    plain: dict[str, np.ndarray] = {}
    for p in x:
        if p.tag not in plain:
            plain[p.tag] = np.array([t == p.tag for t in tags]).astype(np.int64)
        w = plain[p.tag]
        if _leaf(p):
            equal = places.get((p.tag, p.hash))
            if equal:
                w = w.copy()
                w[equal] = 2
        elif p.kids and inner:
            w = w.copy()
            for j, q in inner:
                if q.tag == p.tag:
                    w[j] = known[id(p), id(q)]
        yield w


def _last_row(x: list[Node], y: list[Node], known: dict) -> np.ndarray:
    """Greatest totals of all of x with the first 0, 1, ... nodes of y."""
    row = np.zeros(len(y) + 1, np.int64)
    for w in _weights(x, y, known):
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w))
    return row


def _chosen(x: list[Node], y: list[Node], known: dict) -> list[tuple[Node, Node]]:
    """Pairs of a best alignment of two lists of children."""
    out, todo = [], [(x, y)]
    while todo:
        x, y = todo.pop()
        head = 0
        # equal elements at both ends match each other in some best alignment
        while head < min(len(x), len(y)) and x[head].tag == y[head].tag and x[head].hash == y[head].hash and _leaf(x[head]) == _leaf(y[head]):
            head += 1
        out += zip(x[:head], y[:head], strict=True)
        x, y = x[head:], y[head:]
        tail = 0
        while tail < min(len(x), len(y)) and x[-1 - tail].tag == y[-1 - tail].tag and x[-1 - tail].hash == y[-1 - tail].hash and _leaf(x[-1 - tail]) == _leaf(y[-1 - tail]):
            tail += 1
        if tail:
            out += zip(x[-tail:], y[-tail:], strict=True)
            x, y = x[:-tail], y[:-tail]
        n, m = len(x), len(y)
        if not n or not m:
            continue
        if n * m > CELLS and n > 1:
            half = n // 2
            best = int((_last_row(x[:half], y, known) + _last_row(x[half:][::-1], y[::-1], known)[::-1]).argmax())
            todo += [(x[:half], y[:best]), (x[half:], y[best:])]
            continue
        out += _traced(x, y, _table(x, y, known))
    return out


def _table(x: list[Node], y: list[Node], known: dict) -> np.ndarray:
    """Greatest totals of the first nodes of x with the first nodes of y."""
    rows = np.zeros((len(x) + 1, len(y) + 1), np.int64)
    for i, w in enumerate(_weights(x, y, known)):
        np.maximum(rows[i, 1:], rows[i, :-1] + w, out=rows[i + 1, 1:])
        np.maximum.accumulate(rows[i + 1, 1:], out=rows[i + 1, 1:])
    return rows


def _traced(x: list[Node], y: list[Node], table: np.ndarray) -> list[tuple[Node, Node]]:
    rows, i, j, out = table.tolist(), len(x), len(y), []
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((x[i], y[j]))
    return out


def _weigh(a: Node, b: Node) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], np.ndarray]]:
    """Sizes of the greatest matches of all pairs of inner nodes that an alignment of a and b may ask for, from the leaves up.

    Their tables are kept up to CELLS cells; a pair without one is aligned anew if the alignment takes it.
    """
    known: dict[tuple[int, int], int] = {}
    tables: dict[tuple[int, int], np.ndarray] = {}
    left = CELLS
    stack = [(a, b)]
    while stack:
        p, q = stack[-1]
        if (id(p), id(q)) in known:
            stack.pop()
            continue
        need = [(c, d) for c in p.kids if c.kids for d in q.kids if d.kids and c.tag == d.tag and (id(c), id(d)) not in known]
        if need:
            stack += need
            continue
        stack.pop()
        cells = len(p.kids) * len(q.kids)
        if 0 < cells <= left:
            left -= cells
            tables[id(p), id(q)] = _table(p.kids, q.kids, known)
            known[id(p), id(q)] = 1 + int(tables[id(p), id(q)][-1, -1])
        else:
            known[id(p), id(q)] = 1 + (int(_last_row(p.kids, q.kids, known)[-1]) if cells else 0)
    return known, tables


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Size of the greatest simple tree match of two nodes of one tag, and its pairs of nodes."""
    if a.hash == b.hash and a.tag == b.tag and a.kids and b.kids:
        pairs = list(zip(walk(a), walk(b), strict=True))
        return sum(1 + _leaf(p) for p, _ in pairs), pairs
    if not a.kids or not b.kids:
        return (2 if _leaf(a) and _leaf(b) and a.hash == b.hash else 1), [(a, b)]
    known, tables = _weigh(a, b)
    pairs, todo = [], [(a, b)]
    while todo:
        p, q = todo.pop()
        pairs.append((p, q))
        if p.kids and q.kids:
            table = tables.get((id(p), id(q)))
            todo += _chosen(p.kids, q.kids, known) if table is None else _traced(p.kids, q.kids, table)
    return known[id(a), id(b)], pairs


def _paths(root: Node) -> frozenset[str]:
    """The tags on the way to each element, four deep."""
    found, stack = set(), [(root, "", 0)]
    while stack:
        node, path, depth = stack.pop()
        here = f"{path}/{node.tag}"
        found.add(here)
        if depth < 4:
            stack += [(k, here, depth + 1) for k in node.kids]
    return frozenset(found)


class Reference:
    """A reference page and what all pages tell about its nodes. Its tree is built when it is first asked for."""

    def __init__(self, packed: str, counts: list | None = None) -> None:
        self.paths = frozenset(json.loads(packed)[0])
        self._packed, self._counts = packed, counts

    @cached_property
    def root(self) -> Node:
        return unpack(self._packed)

    @cached_property
    def _pages(self) -> int:
        """Pages that gave evidence; their counts are written to the nodes."""
        nodes, pages = list(walk(self.root)), 0
        for row in self._counts or ():
            if row["node"] < 0:
                pages = row["seen"]
            else:
                node = nodes[row["node"]]
                node.seen, node.same, node.free = row["seen"], row["same"], row["free"]
        return pages

    @cached_property
    def template(self) -> frozenset[int]:
        """Numbers of the constant leaves; the reference agrees with itself."""
        least = max(SUPPORT, SHARE * (self._pages + 1))
        return frozenset(n.number for n in walk(self.root) if _leaf(n) and n.same + 1 >= least)

    @cached_property
    def region(self) -> Node | None:
        """The element of the content, None without enough pages."""
        return self._region() if self._pages + 1 >= SUPPORT else None

    def _region(self) -> Node | None:
        if not self.root.free:
            return None
        at = self.root
        while True:
            below = max((k for k in at.kids if k.kids), key=lambda k: k.free, default=None)
            if below is None or below.free < REGION * self.root.free:
                break
            at = below
        up = at
        while up is not None:
            if up.tag in ("article", "main"):
                return up
            up = up.up
        return at if at is not self.root else None


def nearest(page: Node, references: list[Reference]) -> Reference:
    """The reference whose paths are most like the page's, the first one on ties."""
    own = _paths(page)
    return max(references, key=lambda r: len(own & r.paths) / len(own | r.paths))


# --- what a page tells, and what it says ------------------------------------------------------------------------------


def evidence(page: Node, reference: Reference) -> list[tuple[int, int, int]]:
    """(node, same, free) of the reference's nodes that the page's are aligned with, after (-1, 0, 0); nothing from a copy.

    same: a leaf has the same text. free: characters outside links, of an inner node, that differ from the reference.
    """
    _, pairs = match(page, reference.root)
    to = {p.number: q for p, q in pairs}
    main = {x.number: x.length if _marked(x) else 1 for x in _own_main(reference.root)}
    held = 0
    nodes = list(walk(page))
    for p in nodes:
        p.free = 0
    for p in reversed(nodes):
        if _leaf(p):
            q = to.get(p.number)
            equal = q is not None and _leaf(q) and p.hash == q.hash
            p.free = 0 if equal else p.length - p.linked
            if q is not None and q.number in main:
                held += main[q.number] if equal else 0
        if p.up is not None:
            p.up.free += p.free
    if main and 2 * held > sum(main.values()):
        return []
    return [(-1, 0, 0), *((q.number, int(_leaf(p) and _leaf(q) and p.hash == q.hash), p.free if p.kids else 0) for p, q in pairs)]


def content(page: Node, reference: Reference | None) -> str:
    """Blocks of the page that are content."""
    _unmark(page)
    blocks: list[Node] = []
    if reference is not None and (reference.region is not None or reference.template):
        _, pairs = match(page, reference.root)
        constant = {p.number for p, q in pairs if q.number in reference.template and _leaf(p) and p.hash == q.hash}
        region = next((p for p, q in pairs if q is reference.region), None) if reference.region is not None else None
        if region is not None:
            blocks = [*_headings(region), *_leaves(region, STRONG if _marked(region) else WEAK, True)]
        if not any(x.number not in constant for x in blocks):
            blocks = _own_main(page)
        return "\n".join(x.text for x in blocks if x.number not in constant)
    return "\n".join(x.text for x in _own_main(page))


def _unmark(page: Node) -> None:
    """An element around an article that holds most of the page's text is not left out for its name."""
    nodes = list(walk(page))
    around = set()
    for node in reversed(nodes):
        if node.up is not None and (node.tag in ("article", "main") or node.number in around):
            around.add(node.up.number)
    for node in nodes:
        if node.drop in (WEAK, STRONG) and node.number in around and 2 * node.length > page.length:
            node.drop = NONE


def _marked(node: Node | None) -> bool:
    while node is not None:
        if node.tag in ("article", "main"):
            return True
        node = node.up
    return False


def _headings(region: Node) -> list[Node]:
    """Headings that stand right before a region which no article or main part marks."""
    out: list[Node] = []
    if region.up is not None and not _marked(region):
        kids = region.up.kids
        i = next(i for i, k in enumerate(kids) if k is region)
        while i and kids[i - 1].tag in _HEADINGS and kids[i - 1].drop == NONE:
            i -= 1
            out[:0] = _leaves(kids[i], WEAK, True)
    return out


def _own_main(page: Node) -> list[Node]:
    """The page's main part by its own markup: the largest marked article or main part, or all that is not named otherwise."""
    for tag in ("article", "main"):
        found = [_leaves(r, STRONG, True) for r in _reachable(page) if r.tag == tag]
        best = max(found, key=lambda xs: sum(x.length for x in xs), default=[])
        if best:
            return best
    for least in (WEAK, HARD):
        found = [x for x in _leaves(page, least, least == HARD) if x.tag == "p" or x.linked * 5 < x.length * 4]
        if found:
            return found
    return []


def _reachable(page: Node) -> Iterator[Node]:
    """Nodes outside of what is left out."""
    stack = [page]
    while stack:
        node = stack.pop()
        if node.drop < WEAK or node is page:
            yield node
            stack.extend(reversed(node.kids))


def _leaves(root: Node, least: int, inside: bool) -> list[Node]:
    """Leaves in page order without elements of ``least`` or more reason to be left out; a page's header goes, an article's own does not."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node is not root and (node.drop >= least or (node.head and not inside)):
            continue
        if _leaf(node) and node.length:
            out.append(node)
        stack.extend(reversed(node.kids))
    return out


# --- over all pages ---------------------------------------------------------------------------------------------------


def _host(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, refs): each host's references as a JSON list of (h, skeleton, counts), counts being (node, seen, same, free) over its distinct pages."""
    with scratch(pages.sparkSession) as keep:
        return keep(cut(_wrappers(pages, url_col, html_col)))


def _wrappers(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    rows = pages.where(F.col(html_col).isNotNull()).select(_host(url_col).alias("host"), F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html"))
    shown = rows.where(F.col("html").rlike(r"(?s)(?:\A|>)[^<]*[^<\s]"))
    first = shown.groupBy("host", F.pmod("h", F.lit(REFERENCES)).alias("c")).agg(F.min(F.struct("h", "html")).alias("r")).select("host", "r.h", "r.html")

    def bones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [skeleton(parse(h)) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.string())], names=["host", "h", "skeleton"])

    frames = cut(first.mapInArrow(bones, "host string, h long, skeleton string"))
    listed = frames.groupBy("host").agg(F.to_json(F.array_sort(F.collect_list(F.struct("h", "skeleton")))).alias("refs"))  # REFERENCES a host
    kind = pa.list_(pa.struct([("node", pa.int32()), ("same", pa.int32()), ("free", pa.int64())]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[int, Reference]]] = {}
        for batch in batches:
            own, told = [], []
            for h, source, refs in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                page, found = parse(source), _kept(known, refs)
                best = nearest(page, [f for _, f in found]) if found else None
                name = next((k for k, f in found if f is best), None)
                own.append(name)
                told.append([{"node": a, "same": b, "free": c} for a, b, c in evidence(page, best)] if best is not None and name != h else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int64()), pa.array(told, kind)], names=["host", "h", "ref", "told"])

    seen = _with(rows, listed).select("host", "h", "html", "refs")
    facts = seen.mapInArrow(count, "host string, h long, ref long, told array<struct<node: int, same: int, free: long>>")
    facts = facts.groupBy("host", "h", "ref").agg(F.first("told").alias("told"))
    tally = facts.select("host", "ref", F.inline("told")).groupBy("host", "ref", "node").agg(F.count(F.lit(1)).alias("seen"), F.sum("same").alias("same"), F.sum("free").alias("free"))
    counts = tally.groupBy("host", F.col("ref").alias("h")).agg(F.sort_array(F.collect_list(F.struct("node", "seen", "same", "free"))).alias("counts"))  # a reference's nodes
    return frames.join(counts, ["host", "h"], "left").groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.struct("h", "skeleton", "counts")))).alias("refs"))


def _kept(known: dict[str, list[tuple[int, Reference]]], refs: str | None) -> list[tuple[int, Reference]]:
    if refs is None:
        return []
    if refs not in known:
        if len(known) > 2000:
            known.clear()
        known[refs] = [(r["h"], Reference(r["skeleton"], r.get("counts"))) for r in json.loads(refs)]
    return known[refs]


def _with(pages: DataFrame, frames: DataFrame) -> DataFrame:
    """Each page with its host's references: broadcast only under a checked size."""
    size = frames.agg(F.sum(F.length("refs") + F.length("host") + 16)).first()[0] or 0
    return pages.join(F.broadcast(frames) if size <= BROADCAST_BYTES else frames, "host", "left")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    frames = wrappers(pages, url_col, html_col)
    rows = pages.select(_host(url_col).alias("host"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[int, Reference]]] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = []
                for source, refs in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if not source:
                        texts.append("")
                        continue
                    page, found = parse(source), [f for _, f in _kept(known, refs)]
                    texts.append(content(page, nearest(page, found) if found else None))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return _with(rows, frames).select("page_id", "url", "html", "refs").mapInArrow(run, "page_id long, url string, text string")
