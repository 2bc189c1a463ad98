"""Byte-pair merging over flat numpy arrays: all words of a batch at once, one rank-synchronous round after another.

In a round each word finds its least pair rank (a segmented minimum) and merges every leftmost non-overlapping place
of it, then the arrays are compacted.  Doing all places of one rank at once equals doing them one by one unless a
merge makes a neighbouring pair of the same or a lower rank; such a word merges only its first place in that round.
A vocabulary where each token is made by one merge, later than those of its parts, never needs that test.
A word of more than LONG symbols has too many different ranks for rounds that look at all of it: its places wait under the rank of
their pair, and a round takes the places of the lowest rank only, merges them at once and looks up the pairs beside them.
"""

from __future__ import annotations

import heapq

import numpy as np

LONG = 400
NEVER = np.int64(1) << np.int64(40)


class Pairs:
    """(left, right) to rank and merged symbol; symbols are below 2**31."""

    def __init__(self, left, right, rank, merged, ordered: bool):
        keys = np.asarray(left, np.int64) << np.int64(32) | np.asarray(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], np.int64(2**62))
        self.rank = np.append(np.asarray(rank, np.int64)[order], NEVER)
        self.merged = np.append(np.asarray(merged, np.int64)[order], -1)
        self.ordered = ordered

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in rank and merged; the last place for pairs that do not merge."""
        keys = left << np.int64(32) | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, at, len(self.keys) - 1)


def _alternate(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of places (rising; after: the place that each one's pair ends before), the leftmost that do not overlap."""
    run = np.append(True, after[:-1] != places[1:])
    start = np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
    return (np.arange(len(places)) - start) % 2 == 0


def merge_long(symbols: np.ndarray, pairs: Pairs) -> np.ndarray:
    """The symbols of one long word after all merges."""
    n = len(symbols)
    sym, nxt, prv = np.append(symbols.astype(np.int64), -1), np.arange(1, n + 2), np.arange(-1, n)
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def wait(places: np.ndarray) -> None:
        places = places[nxt[places] < n]
        rank = pairs.rank[pairs.find(sym[places], sym[nxt[places]])]
        some = np.flatnonzero(rank < NEVER)
        some = some[np.argsort(rank[some], kind="stable")]
        if len(some):
            edges = np.flatnonzero(np.diff(rank[some])) + 1
            for r, own in zip(rank[some][np.append(0, edges)].tolist(), np.split(places[some], edges), strict=True):
                if r not in waiting:
                    heapq.heappush(ranks, r)
                waiting.setdefault(r, []).append(own)

    wait(np.arange(n - 1))
    while ranks:
        r = heapq.heappop(ranks)
        places = waiting.pop(r)
        places = np.unique(np.concatenate(places)) if len(places) > 1 else places[0]
        places = places[(sym[places] >= 0) & (nxt[places] < n)]
        at = pairs.find(sym[places], sym[nxt[places]])
        places, at = places[pairs.rank[at] == r], at[pairs.rank[at] == r]  # what was merged meanwhile is gone
        if not len(places):
            continue
        take = _alternate(places, nxt[places])
        hit, new = places[take], pairs.merged[at[take]]
        right = nxt[hit]
        if not pairs.ordered:
            before, after = prv[hit], nxt[right]
            left = np.where(np.append(False, right[:-1] == before[1:]), np.append(-1, new[:-1]), sym[before])
            early = (before >= 0) & (pairs.rank[pairs.find(left, new)] <= r)
            early |= (after < n) & (pairs.rank[pairs.find(new, sym[np.minimum(after, n)])] <= r)
            if early.any():  # up to the first such place; the rest waits for what is due before it
                first = int(np.argmax(early)) + 1
                if len(rest := places[places > right[first - 1]]):
                    heapq.heappush(ranks, r)
                    waiting[r] = [rest]
                hit, new, right = hit[:first], new[:first], right[:first]
        sym[hit], sym[right] = new, -1
        after = nxt[right]
        nxt[hit], prv[after] = after, hit
        wait(np.unique(np.concatenate([prv[hit][prv[hit] >= 0], hit])))
    return sym[:n][sym[:n] >= 0]


def merge_words(sym: np.ndarray, sizes: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, sizes) of the words after all merges; sym holds the words' symbols, sizes of 1 or more, end to end."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    if (long := np.flatnonzero(sizes > LONG)).size:
        ends = np.cumsum(sizes)
        for w in long.tolist():
            m = merge_long(sym[ends[w] - sizes[w] : ends[w]], pairs)
            done.append((m, np.full(len(m), w)))
        short = sizes[of] <= LONG
        sym, of = sym[short], of[short]
    sym = sym.astype(np.int64)
    none = len(pairs.keys) - 1
    at = np.append(pairs.find(sym[:-1], sym[1:]), none)[: len(sym)]
    at[:-1][of[1:] != of[:-1]] = none  # no pair across words
    while len(sym):
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        rank = pairs.rank[at]
        least = np.minimum.reduceat(rank, first)
        least_of = np.repeat(least, np.diff(np.append(first, len(sym))))
        if (least == NEVER).any():
            over = least_of == NEVER
            done.append((sym[over], of[over]))
            live = ~over
            sym, of, at, rank, least_of = sym[live], of[live], at[live], rank[live], least_of[live]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == least_of)
        hit = hit[_alternate(hit, hit + 1)]
        if not pairs.ordered:
            hit = _safe(sym, of, at, rank, hit, pairs)
        sym[hit] = pairs.merged[at[hit]]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        hit = hit - np.arange(len(hit))
        sym, of, at = sym[keep], of[keep], at[keep]
        # only pairs beside a merge are new
        fresh = np.zeros(len(sym), bool)
        fresh[hit] = True
        fresh[:-1] |= fresh[1:]
        fresh[-1] = False
        stale = np.flatnonzero(fresh)
        at[hit[-1]] = none
        new = pairs.find(sym[stale], sym[stale + 1])
        new[of[stale] != of[stale + 1]] = none
        at[stale] = new
    if not done:
        return sym, sizes
    sym, of = (np.concatenate(x) for x in zip(*done, strict=True))
    return sym[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(sizes))


def _safe(sym: np.ndarray, of: np.ndarray, at: np.ndarray, rank: np.ndarray, hit: np.ndarray, pairs: Pairs) -> np.ndarray:
    """Of the places, all of a word, or its first if a merge there makes a pair that is due no later."""
    new = pairs.merged[at[hit]]
    pad = np.concatenate([[0], sym, [0, 0]])
    word = np.concatenate([[-1], of, [-1, -1]])
    left, has_left = pad[hit], word[hit] == of[hit]
    after = np.append(False, np.diff(hit) == 2)  # the neighbour on the left has just merged as well
    left = np.where(after, np.roll(new, 1), left)
    right, has_right = pad[hit + 3], word[hit + 3] == of[hit]
    early = has_left & (pairs.rank[pairs.find(left, new)] <= rank[hit])
    early |= has_right & (pairs.rank[pairs.find(new, right)] <= rank[hit])
    if not early.any():
        return hit
    bad = np.isin(of[hit], of[hit[early]])
    first = np.append(True, of[hit][1:] != of[hit][:-1])
    return hit[~bad | first]
