"""Near-duplicates: bottom-k sketches from one hash function, inverted lists, union-sketch estimates, exact Jaccard.

A document's set holds the hashes of its distinct 5-word shingles; its sketch is the k smallest.

1. One pass over the texts writes (id, set size, set hash, sketch).  Equal sets fall into one class by a grouped
   minimum, so a third of all rows being copies costs one row per task.
2. Two sets that are similar enough share at least ``need`` retained values.  With each sketch ordered by how many
   classes retain a value, rarest first, two such sketches must then share a value among their first size - need + 1.
   Only those go into inverted lists; values that many documents share through a common passage stay out of them.
   A list is cut by set size into overlapping bands, for sets of very different sizes are never similar.
3. Inverted lists give pairs, but never all pairs of a list: each list pairs its most central member (the hub) with
   the others.  Estimates from the union's sketch drop hopeless pairs, full sets decide on the rest, links join components.
4. In a long list that still holds several components, take x and y that are not both linked with the hub h.  The symmetric differences
   D(x), D(y) to h must overlap if x and y are similar: |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|.  So the members
   go into new, much shorter lists keyed by (h, element of the rarest part of D).  Each list that is short then (its pairs are at most
   ``PAIRS_A_MEMBER`` times its members) is compared pair by pair, where the places of the shared element in both differences leave
   room for the overlap; step 3 runs on the others, up to ``LEVELS`` times.  No pair is capped away, and no group's pairs are emitted as such.
5. Components come from the links in written tables: each task contracts up to ``EDGES_A_TASK`` links to stars, and where that leaves several
   tasks' stars, large-star and small-star steps alternate with it.

Hubs, roots and sets that a large share of all rows has are no hot keys: a table of counted, small size is broadcast, and beyond that ``spread_join`` deals
their partners out and ships the one row they are joined with to each part.

What can be lost: a pair at the limit p shares need = share k of the k smallest values of its union unless a binomial
with k and p falls below that, which has a chance under one in a million (k = 64: 39 for p = 0.85, 34 for 0.80).  Sets of at
most p k shingles are compared through whole sets, where nothing is lost.  Steps 3 and 4 lose nothing else.

Null or empty text: empty set, linked with nothing.  Null ids: kept as rows of their own, with a null component.  Rows that
repeat an id count as one document: they share a component, as do several texts of one id.  Very long texts are hashed piece by piece.  Empty tables give empty results; columns
other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import words
from glyphmill.llm.scratch import Scratch
from glyphmill.operators.skew import spread_join

SHINGLE, K, JACCARD_PERCENT = 5, 64, 85
MISSED = 1e-6
LEVELS = 6
PAIRS_A_MEMBER = 150
#: Rows of a few longs, and bytes of sets, that are broadcast at most.  Links that one task contracts.
BROADCAST_ROWS, BROADCAST_BYTES, EDGES_A_TASK = 500_000, 8 << 20, 500_000


@dataclass(frozen=True)
class Limit:
    """What follows from the similarity asked for and the size of sketches."""

    percent: int = JACCARD_PERCENT
    k: int = K

    def __post_init__(self):
        if not 0 < self.percent < 100:
            raise ValueError(f"the similarity must lie between 0 and 100 %: {self.percent}")

    @property
    def tau(self) -> float:
        """Similar sets differ in at most tau * (sum of sizes) elements."""
        return (100 - self.percent) / (100 + self.percent)

    @cached_property
    def share(self) -> float:
        """The share of the union's sketch, in hundredths, that a pair at the limit falls short of with a chance under MISSED."""
        p, below, m = self.percent / 100, 0.0, 0
        while (below := below + math.comb(self.k, m) * p**m * (1 - p) ** (self.k - m)) < MISSED:
            m += 1
        return 100 * m // self.k / 100


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes (as signed longs) of the shingles of a document's word hashes."""
    if not len(h):
        return np.zeros(0, np.int64)
    return np.unique(words.windows(h, min(SHINGLE, len(h)), seed=min(SHINGLE, len(h))).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, h, at in words.hashed(batch.column(1).to_pylist(), words.SPACED):
        yield first, [shingle_set(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _sets(batch):
                keys = [int(words.mix(s.view(np.uint64)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                twos = [int(np.bitwise_xor.reduce(words.mix(s.view(np.uint64) + np.uint64(77))).view(np.int64)) if len(s) else 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(twos, pa.int64()), _lists([s[:k] for s in sets])],
                    names=["id", "n", "h1", "h2", "sketch"],
                )

    return run


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets in _sets(batch):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), _lists(sets)], names=["id", "full"])


def _few(df: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast if its count allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each reaches over the edges)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        nodes, roots = smallest_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))
        some = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(roots[some])], names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch, edges_a_task: int | None = None) -> DataFrame:
    """(node, root) for every node of edges (u, v) but the roots: the smallest node reachable."""
    e, most = scratch.keep("cc", edges.select("u", "v").where("u <> v")), edges_a_task or EDGES_A_TASK
    while True:
        tasks = max(1, -(-e.count() // most))
        e = scratch.keep("cc", (e.coalesce(1) if tasks == 1 else e.repartition(tasks)).mapInArrow(_contract, "u bigint, v bigint"))
        if tasks == 1:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = spread_join(both.where("v > u"), ["u"], "v", least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = spread_join(large, ["u"], "v", least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.keep("cc", moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        # done when every node has one root, and no root has one
        sides = new.select(F.col("u").alias("x"), F.lit(1).alias("a")).union(new.select(F.col("v").alias("x"), F.lit(None)).distinct())
        if sides.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        e = new


def _prefixes(classes: DataFrame, limit: Limit) -> DataFrame:
    """Entries (rep, n, score, v) of the lists of values that similar sketches must share one of; score: how common the
    values of the whole sketch are."""
    n, size = F.col("n"), F.size("sketch")
    need = F.when(n <= limit.k * limit.percent // 100, F.ceil(n * limit.percent / 100)).otherwise(F.ceil(size * limit.share))
    entries = classes.select("rep", size.alias("size"), need.alias("need"), "n", F.explode("sketch").alias("v"))
    shared = entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    common = entries.join(shared, "v").groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("df", "v"))).alias("c"), F.first("size").alias("size"), F.first("need").alias("need"), F.first("n").alias("n"), F.sum(F.log("df")).alias("logs")
    )  # at most k entries a class
    take = (F.col("size") - F.col("need") + 1 - (F.col("size") - F.size("c"))).cast("int")  # values of one class come first
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / limit.percent))
    rows = common.where(take > 0).select("rep", "n", (F.col("logs") / F.col("size")).alias("score"), F.explode(F.slice("c", F.lit(1), take)).alias("x"), band.alias("band"))
    keys = F.array(F.xxhash64("x.v", "band"), F.xxhash64("x.v", F.col("band") + 1))
    return rows.select("rep", "n", "score", F.explode(keys).alias("v"), F.lit(False).alias("linked"), F.lit(True).alias("short"), F.lit(0).alias("size"), F.lit(0).alias("pos"))


def _with_roots(lists: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return lists.withColumn("root", F.col("rep"))
    return lists.join(_few(comp).withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def _split(lists: DataFrame, comp: DataFrame | None, scratch: Scratch) -> DataFrame:
    """The entries of lists that hold several components, with the list's hub: v, rep, n, score, root, hub, hub_root."""
    rows = _with_roots(lists, comp)
    heads = rows.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("score", -F.col("rep"), "rep", "root")).alias("h")).where("lo <> hi")
    heads = scratch.keep("heads", heads.select("v", F.col("h.rep").alias("hub"), F.col("h.root").alias("hub_root")))
    return rows.join(F.broadcast(heads), "v") if heads.count() <= BROADCAST_ROWS else spread_join(rows, ["v"], "rep", heads)


def _with_sets(pairs: DataFrame, sets: DataFrame, id_col: str, set_col: str) -> DataFrame:
    """Written pairs (a, b) with the sets of both as sa and sb."""
    side = lambda of, x: of.select(F.col(id_col).alias(x), F.col(set_col).alias("s" + x))
    if pairs.count() <= BROADCAST_ROWS:
        own = sets
        for x in "ab":  # twice, for either id makes a set wanted
            part = sets.join(F.broadcast(pairs.select(F.col(x).alias(id_col))), id_col, "left_semi").select(id_col, set_col)
            own = part if x == "a" else own.union(part.join(F.broadcast(pairs.select(F.col("a").alias(id_col))), id_col, "left_anti"))
        size = own.agg(F.coalesce(F.sum(F.size(set_col) * 8 + 32), F.lit(0))).first()[0]
        if size <= BROADCAST_BYTES:
            return pairs.join(F.broadcast(side(own, "b")), "b").join(F.broadcast(side(own, "a")), "a")
    return spread_join(pairs.join(side(sets, "b"), "b"), ["a"], "b", side(sets, "a"), keys_of=pairs)


def _links(pairs: DataFrame, classes: DataFrame, full: DataFrame, scratch: Scratch, limit: Limit) -> DataFrame:
    """The distinct pairs (a, b) whose sets are similar enough, as (u, v)."""
    near = _with_sets(scratch.keep("pairs", pairs), classes, "rep", "sketch")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, limit.k)
    near = near.select("a", "b", F.size(union).alias("u"), F.size(F.array_intersect(F.array_intersect("sa", "sb"), union)).alias("i"))
    near = scratch.keep("near", near.where(F.col("i") >= limit.share * F.col("u") - 1).select("a", "b"))
    inter = F.size(F.array_intersect("sa", "sb"))
    both = _with_sets(near, full, "id", "full").select("a", "b", inter.alias("i"), (F.size("sa") + F.size("sb") - inter).alias("u"))
    links = both.where(F.col("i").cast("long") * 100 >= F.col("u").cast("long") * limit.percent)
    links = scratch.keep("links", links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    scratch.drop("near", "pairs")
    return links


def _sublists(split: DataFrame, full: DataFrame, limit: Limit) -> DataFrame:
    """New lists (step 4) of the members of split lists, keyed by hub and an element of the difference to it."""
    m = split.where("rep <> hub").select("hub", "rep", "n", "score").distinct()
    rows = spread_join(m.join(full.select(F.col("id").alias("rep"), F.col("full").alias("fx")), "rep"), ["hub"], "rep", full.select(F.col("id").alias("hub"), F.col("full").alias("fh")), keys_of=m)
    delta = F.concat(F.array_except("fx", "fh"), F.array_except("fh", "fx"))
    rows = rows.select("hub", "rep", "n", "score", F.size("fh").alias("nh"), delta.alias("d")).withColumn("size", F.size("d"))
    linked = F.col("size") <= limit.tau * (F.col("n") + F.col("nh")) + 1e-9
    # two that are not linked, or x linked and y not: either way x holds at least this much of the overlap
    half = F.ceil(F.col("size") * (1 - limit.tau) / 2 - 1e-9)
    # in any pair, for the partner's difference holds the overlap and the sizes of the two sets are close
    rest = F.ceil(F.col("size") - limit.tau * (1 + 100 / limit.percent) * F.col("n") - 1e-9)
    half, rest = F.greatest(F.lit(1), half), F.greatest(F.lit(1), rest)
    rows = rows.select("hub", "rep", "n", "score", "size", linked.alias("linked"), F.greatest(half, rest).alias("half"), F.when(linked, half).otherwise(rest).alias("need"), F.explode("d").alias("e"))
    shared = rows.groupBy("hub", "e").agg(F.count("*").alias("df")).where("df > 1")
    common = rows.join(shared, ["hub", "e"]).groupBy("hub", "rep").agg(
        F.sort_array(F.collect_list(F.struct("df", "e"))).alias("c"), *[F.first(x).alias(x) for x in ("n", "score", "size", "half", "need", "linked")]
    )  # at most the two sets of one pair
    first = lambda need: (F.col("size") - F.col(need) + 1 - (F.col("size") - F.size("c"))).cast("int")
    rows = common.where(first("need") > 0).select("hub", "rep", "n", "score", "linked", first("half").alias("h"), "size", (F.col("size") - F.size("c")).alias("alone"), F.posexplode(F.slice("c", F.lit(1), first("need"))).alias("i", "x"))
    return rows.select("rep", "n", "score", F.xxhash64("hub", "x.e").alias("v"), "linked", (F.col("i") < F.col("h")).alias("short"), "size", (F.col("alone") + F.col("i")).alias("pos"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = JACCARD_PERCENT) -> DataFrame:
    """id, n_shingles, component_id, kept: see the module; percent is the least Jaccard similarity.  Ids are integers."""
    limit = Limit(percent, k)
    spark = df.sparkSession
    scratch = Scratch(spark, "dedup")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kind = "id bigint, n bigint, h1 bigint, h2 bigint, sketch array<bigint>"
    rows = scratch.keep("rows", docs.mapInArrow(_sketches(k), kind))
    filled = rows.where("n > 0")
    classes = filled.where("id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch"))
    classes = scratch.keep("classes", classes)
    # an id with several texts connects their classes
    known = filled.where("id IS NOT NULL").select("id", "h1", "h2", "n")
    several = scratch.keep("several", known.groupBy("id").agg(F.min(F.struct("h1", "h2", "n")).alias("lo"), F.max(F.struct("h1", "h2", "n")).alias("hi")).where("lo <> hi").select("id"))
    comp = None
    if several.count() > 0:
        some = known.join(_few(several), "id", "left_semi").distinct()
        owned = scratch.keep("owned", some.join(classes.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"]).select("id", "rep"))
        twice = spread_join(owned, ["id"], "rep", owned.groupBy("id").agg(F.min("rep").alias("v"))).where("rep <> v")
        links = scratch.keep("twice", twice.select(F.col("rep").alias("u"), "v"))
        comp = components(links, scratch)
    else:
        links = spark.createDataFrame([], "u bigint, v bigint")
    lists = scratch.keep("lists", _prefixes(classes, limit))
    split = scratch.keep("split", _split(lists, comp, scratch))
    if not split.isEmpty():
        ids = scratch.keep("ids", split.select(F.col("rep").alias("wanted")).distinct())
        wanted = docs.join(_few(ids), F.col("id") == F.col("wanted"), "left_semi")
        full = scratch.keep("full", wanted.select("id", "text").mapInArrow(_full, "id bigint, full array<bigint>"))
    for level in range(LEVELS + 1):
        if split.isEmpty():
            break
        # short lists are finished pair by pair; long ones get another round
        one = lambda c: F.sum(F.when(c, 1).otherwise(0))
        each = split.groupBy("v").agg(F.count("*").alias("m"), one(F.col("linked")).alias("x"), one(~F.col("linked") & F.col("short")).alias("y"))
        every = F.col("x") * (F.col("m") - F.col("x")) + F.col("y") * (F.col("y") - 1) / 2
        long, short = (split, None) if level == 0 else (None, split)
        if 0 < level < LEVELS:
            big = scratch.keep("big", each.where(every > PAIRS_A_MEMBER * F.col("m")).select("v"))
            if big.count() > 0:
                big = _few(big)
                long, short = split.join(big, "v", "left_semi"), split.join(big, "v", "left_anti")
        found = []
        if long is not None:
            found.append(long.where("root <> hub_root").select(F.col("hub").alias("a"), F.col("rep").alias("b")))
        if short is not None:
            x, y = (short.select("v", *[F.col(c).alias(c + i) for c in ("rep", "root", "linked", "short", "n", "size", "pos")]) for i in "xy")
            roles = (F.col("linkedx") != F.col("linkedy")) | (~F.col("linkedx") & F.col("shortx") & F.col("shorty"))
            # the first element that two differences share leaves room for the overlap they need; sizes are close, too
            overlap = F.col("sizex") + F.col("sizey") - limit.tau * (F.col("nx") + F.col("ny"))
            room = F.least(F.col("sizex") - F.col("posx"), F.col("sizey") - F.col("posy"))
            may = (2 * room >= overlap - 1e-9) & (100 * F.least("nx", "ny") >= limit.percent * F.greatest("nx", "ny"))
            near = x.join(y, "v").where((F.col("repx") < F.col("repy")) & (F.col("rootx") != F.col("rooty")) & roles & may)
            found.append(near.select(F.col("repx").alias("a"), F.col("repy").alias("b")))
        new = _links(reduce(DataFrame.union, found).distinct(), classes, full, scratch, limit)
        if not new.isEmpty():
            links = links.union(new)
            comp = components(links, scratch)
        if long is None:
            break
        left = scratch.keep("left", _split(long.select("rep", "n", "score", "v", "linked", "short"), comp, scratch))
        if left.isEmpty():
            break
        lists = scratch.keep("lists", _sublists(left, full, limit))
        split = scratch.keep("split", _split(lists, comp, scratch))
    scratch.drop("lists", "split", "left", "ids", "full", "links", "twice", "several", "owned", "big", "heads")  # the result reads rows, classes and components
    sets = classes.select("h1", "h2", "n", "rep")
    if comp is not None:
        sets = sets.join(_few(comp).withColumnRenamed("node", "rep"), "rep", "left")
    else:
        sets = sets.withColumn("root", F.lit(None).cast("long"))
    sets = sets.select("h1", "h2", "n", F.coalesce("root", "rep").alias("root"))
    some = spread_join(filled.select("id", "n", "h1", "h2"), ["h1", "h2", "n"], "id", sets, "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("root")).alias("root"))
    out = some.union(rows.where("n = 0").select("id", "n", F.col("id").alias("root")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept"))
