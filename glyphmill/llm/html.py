"""HTML extraction by wrapper induction.

Every page is parsed to a tree of block nodes.  Each host has a reference page: of up to ``CANDIDATES`` pages with some html, drawn by
hashes of their ids, the one whose tree is most like the others'.  Each page of the host is aligned with it by simple tree matching: the largest order-preserving match of the two trees, computed
from the matches of child lists.  A matched node fills the reference node's slot.  Over all pages of the host, the
texts of a slot are counted; a slot whose commonest text has at least 90 % of eight or more pages is constant,
hence template.  What varies is content, unless the slot's role says otherwise (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments; by element, role attribute, and class or id names made of such words and neutral ones only).  On a page with an
article or main element the content lies in it, unless what varies outside has over ``TEASER`` times its characters (then it is a teaser, and the whole
page counts).  Inside such an element the number of like siblings varies and shifts slots, so a text counts wherever in the element it
stands: one that 90 % of the host's eight or more such pages hold is template.  Only where such texts
make up over half of all text there are they kept: then the pages are copies of one article.

Three passes over the pages, all narrow but one join of the per-host wrapper: minima per host, then counts of
slot texts (combined per batch, then by Spark, before any shuffle), then extraction.  The wrapper goes to the pages by
broadcast if its size, measured, is under ``broadcast_bytes``, otherwise by a join in which AQE may split a hot host.

Depth and width have no bound: trees are walked without recursion, and two child lists whose table would have over
``WIDEST`` squared cells are aligned by halves (Hirschberg), which needs little memory and gives a largest match as well.

Null or empty html: empty text.  Very long pages are parsed whole.  Null urls share the empty host.  Null ids never serve as reference; a host without one has no
constant slots.  Repeated rows give equal texts; an empty table gives an empty result; columns
other than id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.scratch import Scratch
from glyphmill.llm.urls import host_path

CONSTANT_PERCENT, LEAST_PAGES, TEASER = 90, 8, 4
#: In place of a slot: a text inside an article or main element, the pages that have any, and their characters.
WITHIN, PAGES, CHARS = -1, -2, -3

#: Fixed by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
LISTED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

#: Elements, roles, and words of class and id that are no main text.
BOILER = frozenset("nav footer aside form button select svg dialog head menu".split())
ROLES = frozenset("navigation banner complementary contentinfo search alert dialog alertdialog menu menubar form".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert sidebar aside nav navbar navigation menu "
    "breadcrumb breadcrumbs footer masthead newsletter subscribe signup popup modal overlay comment comments reply replies disqus related recommended share sharing social widget toolbar pagination pager".split()
)
#: Words that say where or how a thing stands, not what it is: a name is boilerplate if it has one of WORDS and else only these.
NEUTRAL = frozenset(
    "top bottom left right main site page global primary secondary inner outer wrap wrapper container box block list item items link links button buttons btn bar area section slot unit "
    "col column row header content group panel side text inline float sticky fixed mobile desktop js is has post entry article story news blog user reader readers all new latest more head title "
    "form field icon icons logo count policy the my wp s".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>?)|<[!?/][^>]*(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Odd tags must not hold the marks of ``shape_text``.
PLAIN = str.maketrans("(),", "___")


class Node:
    """A block element: its tag, whether its role is boilerplate, whether it lies in an article or main element, and
    children that are nodes or texts; equal ``shape`` numbers mean equal trees of tags, of ``size`` nodes."""

    __slots__ = ("tag", "boiler", "inside", "children", "text", "shape", "size")

    def __init__(self, tag: str, boiler: bool, inside: bool = False):
        self.tag, self.boiler, self.inside, self.children, self.text, self.shape, self.size = tag, boiler, inside, [], "", -1, 1


def _boiler_name(name: str) -> bool:
    words = {w.lower() for w in NAMES.findall(name)}
    return not words.isdisjoint(WORDS) and words <= WORDS | NEUTRAL


def _boiler(tag: str, attributes: str, inside_main: bool) -> bool:
    if tag in BOILER or (tag == "header" and not inside_main):
        return True
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id"):
            if tag not in ("html", "body") and any(_boiler_name(x) for x in value.split()):
                return True
            continue
        value = value.lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def parse(source: str) -> Node:
    """The tree of block elements; inline elements are transparent, br ends a block."""
    root = Node("#root", False)
    stack = [root]
    opened: Counter = Counter()  # tags on the stack: what is not open is not searched for
    at = 0

    def close(depth: int) -> None:
        opened.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    def put(text: str) -> None:
        if text:
            c = stack[-1].children
            if c and isinstance(c[-1], str):
                c[-1] += text
            else:
                c.append(text)

    while True:
        m = TOKEN.search(source, at)
        if not m:
            put(source[at:])
            break
        put(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        attributes = m[3]
        if not m[4]:  # a lone quote, or the text ends inside a tag
            end = source.find(">", at)
            if end < 0:
                break
            attributes, at = source[m.start(3) : end], end + 1
        tag = m[2].lower().translate(PLAIN)
        if m[1]:
            if tag not in INLINE and opened[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in INLINE:
            continue
        if tag in CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in ("td", "th", "button", "table"):
                    break
        elif tag in LISTED and any(opened[t] for t in LISTED[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SCOPES[tag]:
                    break
                if stack[i].tag in LISTED[tag]:
                    close(i)
                    break
        inside = stack[-1].inside
        node = Node(tag, stack[-1].boiler or _boiler(tag, attributes, inside), inside or tag in ("article", "main"))
        stack[-1].children.append(node)
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
            opened[tag] += 1
    _finish(root)
    return root


_SHAPES: dict[tuple, int] = {}
_NUMBERS = itertools.count()


def _shape(tag: str, children: tuple[int, ...]) -> int:
    """One number for each tree of tags.  When the table is cleared, an old tree may get a second number: then two
    equal trees are compared in full, which gives the same match."""
    key = (tag, *children)
    if key not in _SHAPES:
        if len(_SHAPES) > 200_000:
            _SHAPES.clear()
        _SHAPES[key] = next(_NUMBERS)
    return _SHAPES[key]


def _finish(root: Node) -> None:
    """Own texts and shapes, from the leaves up, without recursion."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [c for c in n.children if isinstance(c, Node)]
    for n in reversed(order):
        n.text = " ".join(" ".join(entities.unescape(c).split()) for c in n.children if isinstance(c, str))
        n.size = 1 + sum(c.size for c in n.children if isinstance(c, Node))
        n.shape = _shape(n.tag, tuple(c.shape for c in n.children if isinstance(c, Node)))


def shape_text(root: Node) -> str:
    """The tree of tags as text: tag(child,child)."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        out.append(n.tag)
        if inner := _nodes(n):
            todo.append(")")
            for i, c in enumerate(reversed(inner)):
                todo += [",", c] if i else [c]
            todo.append("(")
    return "".join(out)


def shape_tree(shape: str) -> Node:
    """The tree that a shape describes."""
    root = Node("", False)
    stack, last = [root], root
    for m in re.finditer(r"[^(),]+|[(),]", shape):
        if m[0] == "(":
            stack.append(last)
        elif m[0] == ")":
            stack.pop()
        elif m[0] != ",":
            last = Node(m[0], False)
            stack[-1].children.append(last)
    out = root.children[0] if root.children else Node("#root", False)
    _finish(out)
    return out


_MATCHED: dict[tuple[int, int], int] = {}
WIDEST, CANDIDATES = 400, 7


def _bounded() -> None:
    """Only between alignments: within one, what is known must stay."""
    if len(_MATCHED) > 100_000:
        _MATCHED.clear()


def matching(a: Node, b: Node) -> int:
    """Simple tree matching: matched pairs of the largest order-preserving match whose roots have one tag."""
    _bounded()
    return _matching(a, b)


def _matching(a: Node, b: Node) -> int:
    if a.tag != b.tag:
        return 0
    if a.shape == b.shape:
        return a.size
    todo = [] if (a.shape, b.shape) in _MATCHED else [(a, b, False)]
    while todo:  # the pairs of children first
        c, d, ready = todo.pop()
        if (c.shape, d.shape) in _MATCHED:
            continue
        x, y = _nodes(c), _nodes(d)
        if not x or not y:
            _MATCHED[c.shape, d.shape] = 1
        elif ready:
            _MATCHED[c.shape, d.shape] = 1 + _largest(x, y)
        else:
            todo.append((c, d, True))
            others = {n.shape: n for n in y}.values()
            for e in {n.shape: n for n in x}.values():
                todo += [(e, f, False) for f in others if e.tag == f.tag and e.shape != f.shape and (e.shape, f.shape) not in _MATCHED]
    return _MATCHED[a.shape, b.shape]


def _ends(x: list[Node], y: list[Node]) -> tuple[int, int]:
    """Lengths of the equal beginnings and ends: some largest match pairs each of these with its like."""
    n, i, j = min(len(x), len(y)), 0, 0
    while i < n and x[i].shape == y[i].shape:
        i += 1
    while j < n - i and x[-1 - j].shape == y[-1 - j].shape:
        j += 1
    return i, j


def _largest(x: list[Node], y: list[Node]) -> int:
    i, j = _ends(x, y)
    out = sum(n.size for n in (*x[:i], *x[len(x) - j :]))
    x, y = x[i : len(x) - j], y[i : len(y) - j]
    if not x or not y:
        return out
    return out + (int(_last_row(x, y)[-1]) if len(x) * len(y) > WIDEST else _table(x, y)[-1][-1])


def _last_row(x: list[Node], y: list[Node]) -> np.ndarray:
    """The largest matches of x with the beginnings of y."""
    kinds: dict[int, int] = {}
    at = np.array([kinds.setdefault(n.shape, len(kinds)) for n in y])
    first = {n.shape: n for n in reversed(y)}
    weights: dict[int, np.ndarray] = {}
    row = np.zeros(len(y) + 1, np.int64)
    for a in x:
        if a.shape not in weights:
            weights[a.shape] = np.array([_matching(a, first[k]) for k in kinds], np.int64)[at]
        new = np.maximum(row[1:], row[:-1] + weights[a.shape])
        row[1:] = np.maximum.accumulate(new)
    return row


def _wide(x: list[Node], y: list[Node]) -> Iterator[tuple[Node, Node]]:
    """The pairs of a largest match of two child lists, in space of their lengths."""
    todo = [(x, y)]
    while todo:
        x, y = todo.pop()
        i, j = _ends(x, y)
        yield from zip(x[:i], y[:i], strict=True)
        yield from zip(x[len(x) - j :], y[len(y) - j :], strict=True)
        x, y = x[i : len(x) - j], y[i : len(y) - j]
        if not x or not y:
            continue
        if len(x) * len(y) <= WIDEST * WIDEST:
            yield from _traced(x, y)
        elif len(x) == 1:
            best = max(y, key=lambda b: _matching(x[0], b))
            if _matching(x[0], best):
                yield x[0], best
        else:
            half = len(x) // 2
            cut = int(np.argmax(_last_row(x[:half], y) + _last_row(x[half:][::-1], y[::-1])[::-1]))
            todo += [(x[:half], y[:cut]), (x[half:], y[cut:])]


def _traced(x: list[Node], y: list[Node]) -> Iterator[tuple[Node, Node]]:
    m, i, j = _table(x, y), len(x), len(y)
    while i and j:
        if m[i][j] == m[i - 1][j]:
            i -= 1
        elif m[i][j] == m[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            yield x[i], y[j]


def _nodes(n: Node) -> list[Node]:
    return [c for c in n.children if isinstance(c, Node)]


def _table(x: list[Node], y: list[Node]) -> list[list[int]]:
    m = [[0] * (len(y) + 1)]
    for a in x:
        row, above = [0], m[-1]
        for j, b in enumerate(y):
            row.append(max(row[j], above[j + 1], above[j] + _matching(a, b)))
        m.append(row)
    return m


def align(page: Node, reference: Node) -> dict[int, int]:
    """id(node) of the page to the slot (preorder number) of its partner in the reference."""
    number, todo = {}, [reference]
    while todo:
        n = todo.pop()
        number[id(n)] = len(number)
        todo += reversed(_nodes(n))
    _bounded()
    slots = {}
    pairs = [(page, reference)] if page.tag == reference.tag else []
    while pairs:
        a, b = pairs.pop()
        slots[id(a)] = number[id(b)]
        x, y = _nodes(a), _nodes(b)
        if a.shape == b.shape:  # alike: each with its like
            pairs += zip(x, y, strict=True)
        else:
            pairs += _wide(x, y) if len(x) * len(y) > WIDEST * WIDEST else _traced(x, y)
    return slots


def most_typical(shapes: list[str]) -> str:
    """The shape most like the others: by matched nodes, as a share of the nodes of both trees."""
    trees = [shape_tree(s) for s in shapes]
    like = [sum(2 * matching(a, b) / (a.size + b.size) for b in trees) for a in trees]
    return shapes[like.index(max(like))]


def _text_hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def slot_texts(page: Node, reference: Node) -> list[tuple[int, int]]:
    """(slot, hash of own text) of the aligned nodes that have text."""
    slots, out, todo = align(page, reference), [], [page]
    while todo:
        n = todo.pop()
        if n.text and id(n) in slots:
            out.append((slots[id(n)], _text_hash(n.text)))
        todo += _nodes(n)
    return out


def inside_texts(page: Node) -> dict[int, int]:
    """Hash and length of the distinct own texts inside the page's article or main elements."""
    out, todo = {}, list(_articles(page))
    while todo:
        n = todo.pop()
        if n.boiler:
            continue
        if n.text:
            out[_text_hash(n.text)] = len(n.text)
        todo += _nodes(n)
    return out


def _articles(page: Node) -> list[Node]:
    return _tops(page, lambda n: n.tag == "article") or _tops(page, lambda n: n.tag == "main")


def extract(page: Node, reference: Node | None, constant: frozenset[int], within: frozenset[int] = frozenset()) -> str:
    """The page's content blocks, one a line; within: hashes of the host's constant texts inside articles."""
    articles = _articles(page)
    drop = set()
    if articles and within:
        todo = list(articles)
        while todo:
            n = todo.pop()
            if n.text and _text_hash(n.text) in within:
                drop.add(id(n))
            todo += _nodes(n)

    def constant_slots() -> set[int]:
        return {i for i, s in align(page, reference).items() if s in constant} if constant and reference is not None else set()

    if not articles:
        return _content([page], constant_slots())
    text = _content(articles, drop)
    if len(_content([page], drop)) > (TEASER + 1) * len(text):  # with the template's texts, at first
        whole = _content([page], drop | constant_slots())
        return whole if len(whole) > (TEASER + 1) * len(text) else text
    return text


def _content(tops: list[Node], drop: set[int]) -> str:
    """The blocks, one a line, without the dropped ones unless they are all."""
    text = "\n".join(_blocks(tops, drop))
    return text if text or not drop else "\n".join(_blocks(tops, set()))


def _tops(page: Node, wanted) -> list[Node]:
    out, todo = [], [page]
    while todo:
        n = todo.pop()
        if n.boiler:
            continue
        if wanted(n):
            out.append(n)
        else:
            todo += reversed(_nodes(n))
    return out


def _blocks(tops: list[Node], drop: set[int]) -> Iterator[str]:
    todo: list = list(reversed(tops))
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            if text := " ".join(entities.unescape(n).split()):
                yield text
        elif not n.boiler:
            todo += [c for c in reversed(n.children) if not (isinstance(c, str) and id(n) in drop)]


def _rows(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    return rows.withColumn("_host", host_path(F.col("_url"))[0])


def induce(df: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """A wrapper per host: host, shape (of the reference tree), constant (its constant slots), within (hashes of the
    constant texts inside articles)."""
    rows = _rows(df, id_col, url_col, html_col)
    drawn = rows.where(F.col("_id").isNotNull() & (F.length(F.trim("_html")) > 0))
    draws = [F.min(F.struct(F.xxhash64(F.lit(i), F.col("_id")).alias("h"), F.col("_id").alias("i"))).alias(f"d{i}") for i in range(CANDIDATES)]
    first = drawn.groupBy("_host").agg(*draws).select(F.col("_host").alias("_h"), F.explode(F.array_distinct(F.array(*[F.col(f"d{i}.i") for i in range(CANDIDATES)]))).alias("_first"))
    first = scratch.keep("first", first)
    few = first.count() * 64 <= broadcast_bytes

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shape_text(parse(t.as_py() or "")) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())], names=["host", "id", "shape"])

    def typical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([most_typical(x) for x in b.column(1).to_pylist()], pa.string())], names=["host", "shape"])

    own = drawn.join(F.broadcast(first) if few else first, (F.col("_id") == F.col("_first")) & (F.col("_host") == F.col("_h")))
    kind = rows.schema["_id"].dataType.simpleString()
    # at most CANDIDATES shapes a host: a repeated id gives one
    trees = own.select("_host", "_id", "_html").mapInArrow(shapes, f"host string, id {kind}, shape string").groupBy("host", "id").agg(F.min("shape").alias("shape"))
    trees = trees.groupBy("host").agg(F.sort_array(F.collect_list("shape")).alias("shapes"))
    refs = scratch.keep("refs", trees.mapInArrow(typical, "host string, shape string"))
    small = refs.agg(F.coalesce(F.sum(F.length("shape") + 64), F.lit(0))).first()[0] <= broadcast_bytes

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            trees: dict[str, Node] = {}
            for host, source, shape in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if host not in trees:
                    trees[host] = shape_tree(shape)
                page = parse(source or "")
                found.update((host, *x, 0) for x in slot_texts(page, trees[host]))
                if inside := inside_texts(page):
                    found.update((host, WITHIN, *x) for x in inside.items())
                    found[host, PAGES, 0, 0] += 1
                    found[host, CHARS, 0, 0] += sum(inside.values())
            keys = list(zip(*found, strict=True)) or [[], [], [], []]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*map(pa.array, keys, kinds), pa.array(found.values(), pa.int64())], names=["host", "slot", "text", "chars", "n"])

    with_ref = rows.join(F.broadcast(refs) if small else refs, F.col("_host") == F.col("host"))
    each = with_ref.select("_host", "_html", "shape").mapInArrow(counts, "host string, slot bigint, text bigint, chars bigint, n bigint").groupBy("host", "slot", "text").agg(F.sum("n").alias("n"), F.max("chars").alias("chars"))
    each = scratch.keep("each", each)
    slots = each.where("slot >= 0").groupBy("host", "slot").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    constant = slots.where((F.col("all") >= LEAST_PAGES) & (F.col("most") * 100 >= F.col("all") * CONSTANT_PERCENT))
    constant = constant.groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("constant"))
    of = lambda slot: F.sum(F.when(F.col("slot") == slot, F.col("n")))
    totals = each.where(F.col("slot") < WITHIN).groupBy("host").agg(of(PAGES).alias("pages"), of(CHARS).alias("all")).where(F.col("pages") >= LEAST_PAGES)
    same = each.where((F.col("slot") == WITHIN) & (F.col("n") >= LEAST_PAGES * CONSTANT_PERCENT // 100)).join(totals, "host").where(F.col("n") * 100 >= F.col("pages") * CONSTANT_PERCENT)
    within = same.groupBy("host").agg(F.sort_array(F.collect_list("text")).alias("within"), F.sum(F.col("n") * F.col("chars")).alias("same"), F.first("all").alias("all")).where("2 * same <= all").select("host", "within")
    return scratch.keep("wrapper", refs.join(constant, "host", "left").join(within, "host", "left"))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """id, url, text, n_chars."""
    scratch = Scratch(df.sparkSession, "html")
    rows = _rows(df, id_col, url_col, html_col)
    wrapper = induce(df, scratch, id_col, url_col, html_col, broadcast_bytes)
    size = wrapper.agg(F.coalesce(F.sum(F.length("shape") + 8 * F.greatest(F.size("constant"), F.lit(0)) + 8 * F.greatest(F.size("within"), F.lit(0)) + 64), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees: dict[str, Node] = {}
            texts = []
            for source, shape, constant, within in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                if shape and constant and shape not in trees:
                    trees[shape] = shape_tree(shape)
                texts.append(extract(parse(source or ""), trees.get(shape), frozenset(constant or ()), frozenset(within or ())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_id", "_url", "text", "n_chars"])

    joined = rows.join(F.broadcast(wrapper) if size <= broadcast_bytes else wrapper, F.col("_host") == F.col("host"), "left")
    kind = rows.schema["_id"].dataType.simpleString()
    out = joined.select("_id", "_url", "_html", "shape", "constant", "within").mapInArrow(run, f"_id {kind}, _url string, text string, n_chars bigint")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias("url"), "text", "n_chars")
