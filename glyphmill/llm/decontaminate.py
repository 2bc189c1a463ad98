"""Benchmark decontamination: CGK random walks, bit-sampling LSH over windows, exact edit distance.

A passage of a document is a leak of a benchmark item if its words (folded: A-Z lower, punctuation dropped) are
within ``floor(0.2 * words of the item)`` insertions, deletions and substitutions of the whole item.

Windows follow from the item's length (``CLASSES``).  From 30 words on, an item lying anywhere in a document covers three or more of its
consecutive windows of 8 words; from 15 on, windows are of 4 words, so that at the full tolerance one of them has at most one edit;
shorter items allow one or two edits and meet overlapping windows.  Items under 5 words allow none: they are sought by a hash of all their words.

Windows are embedded by CGK: at step j the walk writes the word it stands on, and a random bit of (j, word) says whether it
moves on, so a few edits become a few changed places.  It is followed for 3w / 2
steps, in which it rarely leaves the window; a sample that has left it makes no key.  Every table samples some places; a document's window
meets an item's windows (taken at every offset) that wrote the same words there.  The number of tables follows from the target recall.
Each meeting is then decided by the exact edit distance of the whole item to the text around (Myers' bit vectors).

The items are read in blocks of ``block_items`` (a documented bound on what is broadcast); each block scans all rows.
Rows are independent: there is no shuffle.  Null or empty texts and items match nothing; items under 5 words match
only word for word; repeated rows get the same hits; repeated items (same text) are reported under each id; columns with
other names pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import words

TOLERANCE = 0.2
EXACT = 5  # items of fewer words allow no edit
#: From so many words of an item on: the width of its windows, the stride of a document's windows, and walks (None: by the plan).
CLASSES = ((30, 8, 8, None), (15, 4, 4, None), (10, 4, 2, None), (EXACT, 2, 1, None))


def tables_needed(recall: float, agreement: float, places: int) -> int:
    """Tables so that one of them agrees in all its places with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement**places))


@dataclass(frozen=True)
class Plan:
    """recall is asked for at ``agreement``, the share of places that two windows with one or two edits agree in."""

    recall: float = 0.99
    agreement: float = 0.72
    places: int = 4
    tables_a_walk: int = 3
    seed: int = 11

    @property
    def walks(self) -> int:
        return -(-tables_needed(self.recall, self.agreement, self.places) // self.tables_a_walk)


def myers(peq: dict[int, int], n: int, text: list[int]) -> list[int]:
    """For each end in text, the least edit distance of the pattern to a part of text that ends there."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, out = full, 0, n, []
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        out.append(score)
    return out


def _peq(pattern: list[int]) -> dict[int, int]:
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    return peq


class Item:
    def __init__(self, key: int, h: np.ndarray):
        self.key, self.h, self.n = key, h, len(h)
        self.k = math.floor(TOLERANCE * self.n)
        pattern = h.tolist()
        self.forth, self.back = _peq(pattern), _peq(pattern[::-1])

    def best(self, text: list[int]) -> tuple[int, int, int] | None:
        """(distance, start, end) of the nearest part of text, if near enough: least distance, then first end."""
        if sum(map(self.forth.__contains__, text)) < self.n - self.k:  # so many words stay as they are
            return None
        scores = myers(self.forth, self.n, text)
        if not scores or min(scores) > self.k:
            return None
        d = min(scores)
        end = scores.index(d) + 1
        behind = myers(self.back, self.n, text[:end][::-1])
        return d, end - (behind.index(d) + 1), end


class Tables:
    """The LSH tables of the items of one window width."""

    def __init__(self, items: list[Item], width: int, stride: int, walks: int | None, plan: Plan):
        self.items, self.w, self.stride, self.plan = items, width, stride, plan
        walks = walks or plan.walks
        rng = np.random.default_rng(plan.seed + width)
        self.steps = -(-3 * width // 2)
        self.odd = rng.integers(0, 2**63, (walks, self.steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        places = min(plan.places, self.steps)
        self.samples = [[np.sort(rng.choice(self.steps, places, replace=False)) for _ in range(plan.tables_a_walk)] for _ in range(walks)]
        rows = [(i, o) for i, it in enumerate(items) for o in range(it.n - width + 1)]
        self.item, self.offset = np.array(rows, np.int64).T
        grams = self.grams = np.stack([items[i].h[o : o + width] for i, o in rows])
        # an item covers so many windows, if all edits are deletions; its best one has at most their share of the allowed edits, so the rest of its words
        self.need = np.array([width - min(it.k // max(1, (it.n - it.k - width + 1) // width), width - min(2, width)) for it in items])
        self.bits = max(16, min(24, int(len(rows) * 64).bit_length()))
        self.tables = []
        for keys, inside in self.keys(grams):
            order = np.flatnonzero(inside)
            order = order[np.argsort(keys[order], kind="stable")]
            seen = np.zeros(1 << self.bits, bool)
            seen[keys[order] >> np.uint64(64 - self.bits)] = True
            self.tables.append((keys[order], order, seen))

    def keys(self, grams: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For every table, the key of every window, and whether all its samples lie inside the window."""
        n, w = grams.shape
        flat = np.zeros((n, w + 1), np.uint64)
        flat[:, :w] = grams
        flat = flat.ravel()
        base = np.arange(n) * (w + 1)
        for walk, samples in enumerate(self.samples):
            wanted = {int(s) for t in samples for s in t}
            at, wrote = base.copy(), {}
            end = base + w
            for j in range(max(wanted) + 1):
                word = flat[at]
                if j in wanted:
                    wrote[j] = word
                at += (word * self.odd[walk, j] >> np.uint64(63)).astype(np.int64)
                np.minimum(at, end, out=at)
            for t in samples:
                key, last = np.zeros(n, np.uint64), int(t[-1])
                for j in t.tolist():
                    key = (key ^ wrote[j]) * np.uint64(0x9FB21C651E98DF25)
                    key ^= key >> np.uint64(29)
                yield key * np.uint64(0xD6E8FEB86659FD93), wrote[last] != 0

    def meetings(self, grams: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, entry) pairs with equal keys."""
        for (known, order, seen), (keys, inside) in zip(self.tables, self.keys(grams), strict=True):
            some = np.flatnonzero(seen[keys >> np.uint64(64 - self.bits)] & inside)
            lo, hi = np.searchsorted(known, keys[some], "left"), np.searchsorted(known, keys[some], "right")
            n = hi - lo
            at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            window, entry = np.repeat(some, n), order[at]
            for a in range(0, len(window), 1 << 16):
                x, y = window[a : a + (1 << 16)], entry[a : a + (1 << 16)]
                same = (grams[x][:, :, None] == self.grams[y][:, None, :]).any(2).sum(1)
                near = same >= self.need[self.item[y]]
                yield x[near], y[near]


class Exact:
    """Items too short for any edit, by a hash of all their words."""

    def __init__(self, items: list[Item]):
        self.by: dict[int, dict[int, list[Item]]] = {}
        for it in items:
            self.by.setdefault(it.n, {}).setdefault(int(words.windows(it.h, it.n)[0]), []).append(it)
        self.known = {n: np.array(sorted(own), np.uint64) for n, own in self.by.items()}

    def scan(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, Item, int, int, int]]:
        for n, own in self.by.items():
            keys = words.windows(h, n)
            found: set[tuple[int, int]] = set()
            for i in np.flatnonzero(np.isin(keys, self.known[n])).tolist():
                row = int(np.searchsorted(at, i, "right")) - 1
                if i + n > at[row + 1] or (row, int(keys[i])) in found:  # over the row's end, or not the first place
                    continue
                found.add((row, int(keys[i])))
                for it in own[int(keys[i])]:
                    yield row, it, 0, i - int(at[row]), i + n - int(at[row])


class Scanner:
    def __init__(self, items: list[tuple[int, np.ndarray]], plan: Plan):
        by: dict[int, list[Item]] = {}
        for key, h in items:
            if len(h):
                by.setdefault(next((c for c in CLASSES if c[0] <= len(h)), ()), []).append(Item(key, h))
        self.exact = Exact(by.pop((), []))
        self.tables = [Tables(own, *c[1:], plan) for c, own in sorted(by.items(), key=lambda x: x[0][0], reverse=True)]

    def scan(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, Item, int, int, int]]:
        """(row, item, distance, start, end) for rows whose words are h[at[row]:at[row + 1]]; the best place of each item."""
        yield from self.exact.scan(h, at)
        sizes = np.diff(at)
        for t in self.tables:
            w = t.w
            n = -(-sizes // t.stride)
            if not n.sum():
                continue
            row = np.repeat(np.arange(len(n)), n)
            start = at[:-1][row] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * t.stride
            place = start[:, None] + np.arange(w)
            grams = np.where(place < at[1:][row][:, None], h[np.minimum(place, len(h) - 1)], np.uint64(0))
            found = [(start[a] - t.offset[b] - at[:-1][row[a]], row[a], t.item[b]) for a, b in t.meetings(grams)]
            if not sum(len(f[0]) for f in found):
                continue
            spots = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)], 1)[:, [1, 2, 0]], axis=0)
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for r, i, first in spots.tolist():
                item = t.items[i]
                lo, hi = max(0, first - 2 * item.k), min(int(sizes[r]), first + item.n + 2 * item.k)
                hit = item.best(h[at[r] + lo : at[r] + hi].tolist()) if hi > lo else None
                if hit:
                    hit = (hit[0], hit[1] + lo, hit[2] + lo)
                    best[r, i] = min(hit, best.get((r, i), hit))
            for (r, i), hit in best.items():
                yield r, t.items[i], *hit


def _blocks(items: DataFrame, id_col: str | None, text_col: str, block_items: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Hashed items, a block at a time; without a column of ids every item is taken, as number 0."""
    block: list[tuple[int, str]] = []

    def made() -> list[tuple[int, np.ndarray]]:
        out = []
        for first, h, at in words.hashed([t for _, t in block], words.ALNUM):
            out += [(block[first + i][0], h[a:b]) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
        return out

    for r in items.select((F.col(id_col) if id_col else F.lit(0)).alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").toLocalIterator():
        block.append((r.i, r.t))
        if len(block) == block_items:
            yield made()
            block = []
    if block:
        yield made()


def _hits(scanner: Scanner, texts: list[str | None]) -> Iterator[tuple[int, Item, int, int, int]]:
    for first, h, at in words.hashed(texts, words.ALNUM):
        for r, *rest in scanner.scan(h, at):
            yield (first + r, *rest)


_BUILT: dict[str, Scanner] = {}


def _scanner(shared) -> Scanner:
    name, block, plan = shared.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Scanner(block, plan)
    return _BUILT[name]


def _shared(df: DataFrame, block: list, plan: Plan):
    name = f"{len(block)}:{hash(tuple((k, h.tobytes()) for k, h in block))}:{plan}"
    return df.sparkSession.sparkContext.broadcast((name, block, plan))


def leaks(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    plan: Plan | None = None, block_items: int = 20_000,
) -> DataFrame:
    """id, item_id, n_words (of the item), distance, first_word, last_word (exclusive): a row per document row and leaked item."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _item bigint, n_words bigint, distance bigint, first_word bigint, last_word bigint"
    out = None
    for block in _blocks(items, item_id, item_text, block_items):
        shared = _shared(df, block, plan or Plan())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(shared)
            for batch in batches:
                hits = list(_hits(scanner, batch.column(1).to_pylist()))
                ids = batch.column(0).take(pa.array([x[0] for x in hits], pa.int64()))
                values = list(zip(*[(it.key, it.n, d, a, b) for _, it, d, a, b in hits], strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(v, pa.int64()) for v in values]], names=["_id", "_item", "n_words", "distance", "first_word", "last_word"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    if out is None:
        out = df.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_item", item_id)


def without_leaks(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", plan: Plan | None = None, block_items: int = 20_000) -> DataFrame:
    """The rows of df, all columns, that leak no item, with an id or without: item_id is not read."""
    schema, place = df.schema, df.columns.index(text_col)
    for block in _blocks(items, None, item_text, block_items):
        shared = _shared(df, block, plan or Plan())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(shared)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for hit in _hits(scanner, batch.column(place).to_pylist()):
                    keep[hit[0]] = False
                yield batch.filter(pa.array(keep))

        df = df.mapInArrow(run, schema)
    return df
