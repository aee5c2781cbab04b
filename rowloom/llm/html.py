"""Main text of web pages by wrapper induction.

Pages of one host and layout (see ``layout``) share a template. Each page becomes a DOM tree; the tree is reduced to a
skeleton (siblings of one kind become one node) and aligned with the layout's template by simple
tree matching: the largest set of matching nodes that keeps order and ancestry. An element whose
text is said on all pages is template, inside articles too, if ``ENOUGH_PAGES`` of the pages
differ in their longest text (copies are no evidence); other text varies. A template
is small, and templates can be merged in any grouping, so every task folds all of its pages
into one template for each layout of a host, and these are merged in two steps. Nodes are
aligned by tag, with shared classes as weight; kinds that stay unmatched because their classes
differ by page are merged when there are many, so a template stays small.

The wrapper of a layout names the content slot (the one with most varying text that is not links;
an article or main element counts as ``HINT`` times its text) and the constant elements. From each
page's slot the blocks are read in order, without constant ones and what marks itself as something else: menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments.

Defined results: null or empty html gives an empty text; a page without its layout's slot has the
one that it would have alone; a page without a host belongs to the host ''; repeated rows give repeated results; elements
nested to any depth are read (templates see those below ``DEEPEST`` levels as children of that
level); other columns are not read. Html of
any length is read whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowloom.llm.common import cut, slices

#: Levels of a template. What lies deeper takes part as children of that level; no text is lost by it.
DEEPEST = 100
#: Bytes of wrappers that are broadcast, at most; beyond them rows are joined with theirs.
BROADCAST_BYTES = 16 << 20
#: Pages from which on a text that they all share counts as template.
ENOUGH_PAGES = 10
#: Kinds of one tag that a node of a template has, about at most: beyond it the rarest are merged, their classes dropped.
KINDS = 12
# Fixed value: elements that are the same whatever their classes.
SINGLE = frozenset("# html head body main article".split())
#: Elements that can be the content slot; of these, the named ones count as so many times their text.
SLOTS, NAMED, HINT = frozenset("# html body main article section div center table tbody tr td".split()), frozenset(["article", "main"]), 3

# Fixed values of HTML: elements without content, elements that end an open paragraph, and what an opening element ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
RAW = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea select option button input label".split())
APART = frozenset("nav header footer aside form menu dialog fieldset".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert toolbar".split())
MARKS = re.compile(r"^(ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|foot|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|comments?|reader-?comments|disqus|respond|replies|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|toolbar|widget|pagination|pager)$")

#: Elements that hold text themselves: a whole class marks them as something else, not the first part of one (ad-hoc, share-price).
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption dl dt dd li td th span a b i em strong code".split())


@lru_cache(1 << 14)
def kind_of(tag: str, classes: str, name: str, role: str) -> tuple[str, bool]:
    """The kind of an element (tag and classes, digits as one), and whether it marks itself as something else than text."""
    own = classes.lower().split()
    marks = [*own, *name.lower().split()]
    if tag not in TEXTUAL:
        marks += [re.split(r"[-_]", x)[0] for x in marks]
    apart = tag in APART or role.lower() in ROLES or any(MARKS.match(x) for x in marks)
    return ".".join([tag, *sorted({re.sub(r"\d+", "#", x.replace(".", "")) for x in own})]), apart


class Node:
    __slots__ = ("tag", "sig", "apart", "children", "sum", "chars", "own", "long")

    def __init__(self, tag: str, attrs: list[tuple[str, str | None]]):
        found = {k: v or "" for k, v in attrs if k in ("class", "id", "role")}
        self.tag, self.children = tag, []
        self.sig, self.apart = kind_of(tag, found.get("class", ""), found.get("id", ""), found.get("role", ""))


class Tree(HTMLParser):
    """Builds the tree; forgiving in the way of browsers: missing end tags are implied, stray ones ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#", [])
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}  # places of the open elements by tag
        self.blocks: list[int] = []

    def _pop_to(self, i: int) -> None:
        for node in reversed(self.open[i:]):
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
        del self.open[i:]

    def _last(self, tag: str) -> int:
        """The place of the innermost open element of a tag; 0 if there is none."""
        return self.at[tag][-1] if self.at.get(tag) else 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK and (p := self._last("p")) and self.blocks[-1] == p:
            self._pop_to(p)
        if tag in ENDS:
            held = max(self._last(t) for t in HOLDS[tag])
            inner = [(x := self.at.get(t, []))[(i := bisect_right(x, held)) : i + 1] for t in ENDS[tag]]
            if at := min((x[0] for x in inner if x), default=0):
                self._pop_to(at)
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            if tag in BLOCK:
                self.blocks.append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if i := self._last(tag):
            self._pop_to(i)

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def sums(root: Node) -> None:
    """Gives each element the hash of the text that it shows ('' without text), the number of its characters, of those of its own, and the longest text without elements in it."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.children if not isinstance(x, str)]
    for node in reversed(order):
        parts, chars, node.own, long = [], 0, 0, ""
        for x in node.children:
            if isinstance(x, str):
                if own := " ".join(x.split()):
                    parts.append(own)
                    node.own += len(own)
                    if len(own) >= len(long):
                        long = max(long, own, key=lambda t: (len(t), t))
            elif not x.apart and x.sum:
                parts.append("\0" + x.sum)
                chars += x.chars
                if len(x.long) >= len(long):
                    long = max(long, x.long, key=lambda t: (len(t), t))
        node.long, node.chars = long, chars + node.own
        node.sum = digest("\0".join(parts)) if parts else ""


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def skeleton(node: Node, keep: bool = False) -> dict:
    """One page as a template of its own: s kind, a whether it is apart, o whether n may count a page twice, n pages, m elements, t texts of single elements that all pages have (hash: characters), c characters, l those in links, k children; d the hashes of different pages (the ENOUGH_PAGES smallest). With keep also e, the elements."""
    sums(node)
    return _skeleton([node], False, keep) | {"d": [digest(node.long)]}


def _skeleton(nodes: list[Node], linked: bool, keep: bool, level: int = 1) -> dict:
    tag = nodes[0].tag
    linked = linked or tag == "a"
    kinds: dict[str, list[Node]] = {}
    todo = nodes[::-1]
    own = sum(x.own for x in nodes)
    while todo and level <= DEEPEST:
        node, below = todo.pop(), []
        for x in node.children:
            if not isinstance(x, str):
                kinds.setdefault(x.sig, []).append(x)
                if level == DEEPEST and not x.apart:  # all that is below, in page order
                    below.append(x)
        todo += below[::-1]
    children = [] if tag in RAW else [_skeleton(v, linked, keep, level + 1) for v in kinds.values()]
    if not keep:
        children = gathered([(1, x) for x in children])
    chars = own + sum(x["c"] for x in children)
    out = {"s": nodes[0].sig, "a": int(nodes[0].apart), "o": 0, "n": 1, "m": len(nodes), "t": {} if nodes[0].apart else {x.sum: x.chars for x in nodes if x.sum}, "c": chars, "l": chars if linked else sum(x["l"] for x in children), "k": children}
    return out | {"e": nodes} if keep else out


def likeness(a: str, b: str) -> float:
    """1 for equal kinds, less for one tag with other classes, 0 if two nodes cannot be the same: other tags, or classes of which none is shared."""
    if a == b:
        return 1.0
    (tag, *x), (other, *y) = a.split("."), b.split(".")
    if tag != other:
        return 0.0
    shared = len({*x} & {*y})
    return 0.5 + 0.5 * shared / len({*x} | {*y}) if shared or not x or not y or tag in SINGLE else 0.0


def layout(root: Node) -> str:
    """Which elements make up a page: the tag paths of its containers, down to two levels below the body, and whether it has an article or main element."""
    paths, todo = set(), [(root, "", 0)]
    while todo:
        node, path, depth = todo.pop()
        if node.tag in NAMED:
            paths.add(f"~{node.tag}")
        for x in node.children:
            if not isinstance(x, str) and not x.apart:
                inner = x.tag in SLOTS and x.tag not in ("html", "body")
                here = f"{path}/{x.tag}" if inner and depth < 2 else path
                if inner and depth < 2:
                    paths.add(here)
                todo.append((x, here, depth + 1 if x.tag not in ("html", "body") else depth))
    return " ".join(sorted(paths))


def matching(a: dict, b: dict) -> tuple[float, list[tuple[int, int]]]:
    """Simple tree matching: how much of two trees matches, and which children are matched."""
    alike = likeness(a["s"], b["s"])
    if not alike or a["a"] != b["a"]:
        return 0, []
    x, y = a["k"], b["k"]
    w = [[matching(p, q)[0] for q in y] for p in x]
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + w[i][j])
    i, j, pairs = len(x), len(y), []
    while i and j:
        if w[i - 1][j - 1] and m[i][j] == m[i - 1][j - 1] + w[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif m[i][j] == m[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return m[len(x)][len(y)] + alike, pairs[::-1]


def pairs_of(a: dict, b: dict) -> list[tuple[int, int]]:
    """Which children of two nodes match. Those of the same kinds in the same order match one to one."""
    if [(x["s"], x["a"]) for x in a["k"]] == [(x["s"], x["a"]) for x in b["k"]]:
        return [(i, i) for i in range(len(a["k"]))]
    return matching(a, b)[1]


def common_kind(a: str, b: str) -> str:
    """The tag with the classes that both kinds have."""
    (tag, *x), y = a.split("."), {*b.split(".")[1:]}
    return ".".join([tag, *(c for c in x if c in y)])


def merged(a: dict, b: dict) -> dict:
    """Two templates as one; unmatched children are kept where they stood."""
    pairs = pairs_of(a, b)
    children, i, j = [], 0, 0
    for p, q in [*pairs, (len(a["k"]), len(b["k"]))]:
        children += [(1, x) for x in a["k"][i:p]] + [(2, x) for x in b["k"][j:q]]
        if p < len(a["k"]) and q < len(b["k"]):
            children.append((3, merged(a["k"][p], b["k"][q])))
        i, j = p + 1, q + 1
    out = {"s": common_kind(a["s"], b["s"]), "a": a["a"], "o": a["o"] | b["o"], "n": a["n"] + b["n"], "m": a["m"] + b["m"], "t": {h: a["t"][h] for h in a["t"].keys() & b["t"].keys()}, "c": a["c"] + b["c"], "l": a["l"] + b["l"], "k": gathered(children)}
    return out | {"d": sorted({*a["d"], *b["d"]})[:ENOUGH_PAGES]} if "d" in a and "d" in b else out


def gathered(children: list[tuple[int, dict]]) -> list[dict]:
    """Children of one kind as one; if over ``KINDS`` are left of a tag (classes that differ by page), the rarest of them, too. Each comes with the sides whose pages have it (bits)."""
    kinds: dict[tuple, tuple[int, dict]] = {}

    def put(key: tuple, side: int, x: dict) -> None:
        if key in kinds:
            other, y = kinds[key]
            x = merged(y, x)
            x["o"] |= int(bool(side & other))
            side |= other
        kinds[key] = side, x

    for side, x in children:  # some could not be matched in order
        put((x["s"], x["a"]), side, x)
    tags: dict[tuple, list[tuple]] = {}
    for key in kinds:
        tags.setdefault((key[0].split(".")[0], key[1]), []).append(key)
    for (tag, apart), keys in tags.items():
        if len(keys) > KINDS:
            n = lambda k: kinds[k][1]["n"]
            keys.sort(key=n)
            rare = keys[: max(len(keys) - KINDS + 1, sum(n(k) == n(keys[0]) for k in keys))]
            parts = [kinds.pop(k) for k in rare]
            for side, x in parts:
                put((tag, apart), side, x | {"s": tag})
    return list(x for _, x in kinds.values())


def wrapper(template: dict) -> dict:
    """The template's tree with r: whether the node is the content slot, x: the texts that it says on all pages. s, a and k as in ``skeleton``."""
    pages, slots = template["n"], []
    enough = len(template["d"]) >= ENOUGH_PAGES

    def visit(node: dict, depth: int) -> tuple[dict, int]:
        """The node of the wrapper, and its characters that are neither constant nor apart."""
        below = [visit(x, depth + 1) for x in node["k"]]
        constant = sorted(node["t"]) if enough and node["n"] == pages and not node["a"] and not node["o"] else []
        out = {"s": node["s"], "a": node["a"], "r": 0, "x": constant, "k": [x for x, _ in below]}
        if node["a"]:
            return out, 0
        varying = node["c"] - sum(x["c"] for x in node["k"]) + sum(n for _, n in below)
        if not any(x["x"] for x, _ in below):  # else they have been taken off below
            varying -= pages * sum(node["t"][h] for h in constant)
        tag = node["s"].split(".")[0]
        if tag in SLOTS and (node["m"] == node["n"] or tag in NAMED):
            slots.append((max(0, varying - 2 * node["l"]) * (HINT if tag in NAMED else 1), depth, len(slots), out))
        return out, max(0, varying)

    out = visit(template, 0)[0]
    # Of the slots that hold nearly all of the text the deepest one.
    best = max((s[0] for s in slots), default=0)
    root = max((s for s in slots if s[0] >= 0.8 * best), key=lambda s: (s[1], s[0], -s[2]), default=(0, 0, 0, out))[3]
    root["r"] = 1
    if root["x"]:  # a slot that never varies is no template
        todo = [root]
        while todo:
            node = todo.pop()
            node["x"] = []
            todo += node["k"]
    return out


def placed(page: dict, wrap: dict) -> dict[int, dict]:
    """The wrapper's node for each element (by id) of a page's skeleton that matches one."""
    out, todo = {}, [(page, wrap)]
    while todo:
        a, b = todo.pop()
        out |= dict.fromkeys(map(id, a["e"]), b)
        todo += [(a["k"][i], b["k"][j]) for i, j in pairs_of(a, b)]
    return out


def in_links(root: Node) -> int:
    """Characters of the element's text that stand in links."""
    total, todo = 0, [root]
    while todo:
        x = todo.pop()
        if x.tag == "a":
            total += x.chars
        else:
            todo += [y for y in x.children if not isinstance(y, str) and not y.apart]
    return total


def main_blocks(root: Node, wrap: dict) -> list[str]:
    """The blocks of the page's content slot, in page order; of the slot that the page alone would have if it lacks the layout's."""
    page = skeleton(root, keep=True)
    at = placed(page, wrap)

    def slots(at: dict[int, dict]) -> list[Node]:
        out, todo = [], [root]
        while todo:
            node = todo.pop()
            if id(node) in at and at[id(node)]["r"]:
                out.append(node)
            else:
                todo += [x for x in reversed(node.children) if not isinstance(x, str) and not x.apart]
        return out

    starts = slots(at)
    if not any(x.chars for x in starts):
        starts = slots(placed(page, wrapper(page)))
    if len(starts) > 1:  # teasers of other pages are links for the most part
        starts = [x for x in starts if 2 * in_links(x) < x.chars] or starts
    blocks, text = [], []

    def flush() -> None:
        if line := " ".join("".join(text).split()):
            blocks.append(line)
        text.clear()

    for start in starts:
        todo = [start]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                text.append(x)
            elif not x.apart and (x is start or id(x) not in at or x.sum not in at[id(x)]["x"]):
                if x.tag == "br":
                    text.append(" ")
                if x.tag in BLOCK:
                    flush()
                    todo.append(None)
                todo += reversed(x.children)
        flush()
    return blocks


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"), host.alias("host"))


def templates(rows: DataFrame) -> DataFrame:
    """(host, layout, template): all pages take part."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict] = {}
        pack = lambda: pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in held], pa.string()) for i in (0, 1)), pa.array([json.dumps(t) for t in held.values()], pa.string())], names=["host", "layout", "template"])
        for batch in batches:
            for part in slices(batch, "html"):
                for host, html in zip(part.column(3).to_pylist(), part.column(2).to_pylist()):
                    root = parse(html.decode("utf-8", errors="replace"))
                    page, key = skeleton(root), (host, layout(root))
                    held[key] = merged(held[key], page) if key in held else page
                if len(held) > 1000:
                    yield pack()
                    held.clear()
        if held:
            yield pack()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for x in sorted(pdf["template"]):
            x = json.loads(x)
            out = x if out is None else merged(out, x)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "layout": [pdf["layout"].iloc[0]], "template": [json.dumps(out)]})

    kind = "host string, layout string, template string"
    partial = rows.mapInArrow(fold, kind).withColumn("salt", F.pmod(F.xxhash64("template"), F.lit(32)))
    return partial.groupBy("host", "layout", "salt").applyInPandas(join, kind).groupBy("host", "layout").applyInPandas(join, kind)


def wrappers(rows: DataFrame) -> DataFrame:
    """(host, layout, wrapper): the wrapper as JSON."""

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([json.dumps(wrapper(json.loads(t))) for t in batch.column(2).to_pylist()], pa.string())], names=["host", "layout", "wrapper"])

    return templates(rows).mapInArrow(induce, "host string, layout string, wrapper string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: page_id, url, text (blocks joined by an empty line), n_chars."""
    rows = _rows(pages, id_col, url_col, html_col)
    wraps = cut(wrappers(rows))
    size = F.octet_length("host") + F.octet_length("layout") + F.octet_length("wrapper") + 200
    few = (wraps.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES
    shared = pages.sparkSession.sparkContext.broadcast({(r.host, r.layout): r.wrapper for r in wraps.collect()}) if few else None

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                yield part.append_column("layout", pa.array([layout(parse(html.decode("utf-8", errors="replace"))) for html in part.column(2).to_pylist()], pa.string()))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            for part in slices(batch, "html"):
                out = []
                for html, of in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    root = parse(html.decode("utf-8", errors="replace"))
                    wrap = shared.value[of, layout(root)] if few else of
                    if wrap not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[wrap] = json.loads(wrap)
                    out.append("\n\n".join(main_blocks(root, known[wrap])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = "page_id long, url string, text string, n_chars long"
    if few:
        return rows.mapInArrow(extract, kind)
    known = rows.mapInArrow(laid, "page_id long, url string, html binary, host string, layout string")
    return known.join(wraps, ["host", "layout"]).select("page_id", "url", "html", "wrapper").mapInArrow(extract, kind)
