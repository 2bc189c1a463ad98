"""The row-local path: one broadcast numpy model, Arrow batches, and a table of vectors per distinct token.

It serves SQL functions and streams, where no shuffle is wanted, and gives the exact order of equal scores.  A batch of texts becomes flat arrays:
token numbers end to end, segmented sums of token vectors, one matrix product with the output rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions.columns import FNV_BASIS, FNV_PRIME, NGRAM_FACTOR, U32
from glyphmill.sources.errors import EmptyInputError, InvalidModelError
from glyphmill.sources.model_file import EOS, LABEL_PREFIX, Model

#: Fixed: the characters of Unicode White_Space.
SPLIT = re.compile("[^\t-\r \x85\xa0  -     　]+")
MEMO_TOKENS = 200_000
#: Tokens that are summed at once.
BATCH_TOKENS = 1 << 18
PREDICTIONS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("probability", T.FloatType())]))


def fnv1a(raw: bytes) -> int:
    h = FNV_BASIS
    for b in raw:
        h = (h ^ (b + (U32 - 255) if b >= 128 else b)) * FNV_PRIME & U32
    return h


class BoundedHeap:
    """The k largest of what is offered, in a binary min-heap; an offer equal to the least replaces it."""

    def __init__(self, k: int):
        self.k, self.items = k, []

    def full_above(self, score: float) -> bool:
        return len(self.items) == self.k and score < self.items[0][0]

    def offer(self, score: float, label: int) -> None:
        if self.full_above(score):
            return
        h = self.items
        h.append((score, label))
        i = len(h) - 1
        while i and h[i][0] < h[(i - 1) // 2][0]:
            h[i], h[(i - 1) // 2] = h[(i - 1) // 2], h[i]
            i = (i - 1) // 2
        if len(h) > self.k:
            h[0], h[-1] = h[-1], h[0]
            h.pop()
            i = 0
            while True:
                child = 2 * i + 1
                if child >= len(h):
                    break
                if child + 1 < len(h) and h[child + 1][0] < h[child][0]:
                    child += 1
                if not h[child][0] < h[i][0]:
                    break
                h[i], h[child] = h[child], h[i]
                i = child

    def ranked(self) -> list[tuple[float, int]]:
        return sorted(self.items, key=lambda x: -x[0])


class Predictor:
    """Features, vectors and predictions of one text at a time, in single precision."""

    def __init__(self, model: Model):
        self.m, a = model, model.args
        self.ids = {w: i for i, w in enumerate(model.words)}
        self.kinds = model.kinds.tolist()
        self.bucket, self.minn, self.maxn, self.ngrams = (int(a[x]) for x in ("bucket", "minn", "maxn", "word_ngrams"))
        self.labels = model.labels
        self.memo: dict[str, tuple[int, list[int], int]] = {}
        self._forget()
        if model.tree is not None:
            self.children: dict[int, dict[bool, tuple[str, int]]] = {}
            for label, path in ((i, p) for i, p in enumerate(model.tree) if p):
                for (row, right), follow in zip(path, [*[("node", r) for r, _ in path[1:]], ("leaf", label)], strict=True):
                    self.children.setdefault(row, {})[right] = follow

    def _row(self, h: int) -> list[int]:
        if self.m.prune_size < 0:
            return [self.m.nwords + h]
        to = self.m.prune.get(h) if self.m.prune_size else None
        return [] if to is None else [self.m.nwords + to]

    def subwords(self, token: str) -> list[int]:
        if self.maxn <= 0 or self.minn < 0:
            return []
        chars = [c.encode() for c in f"<{token}>"]
        out = []
        for i in range(len(chars)):
            for n in range(max(self.minn, 1), self.maxn + 1):
                if i + n > len(chars):
                    break
                if n == 1 and i in (0, len(chars) - 1):
                    continue
                out += self._row(fnv1a(b"".join(chars[i : i + n])) % self.bucket)
        return out

    def _token(self, token: str) -> tuple[int, list[int], int]:
        """(kind, ids, hash)."""
        if token not in self.memo:
            if len(self.memo) >= MEMO_TOKENS:
                self.memo.clear()
            i = self.ids.get(token, -1)
            kind = self.kinds[i] if i >= 0 else int(token.startswith(LABEL_PREFIX))
            ids = [] if kind else ([i] if i >= 0 else []) + (self.subwords(token) if token != EOS else [])
            self.memo[token] = kind, ids, fnv1a(token.encode())
        return self.memo[token]

    def line(self, text: str) -> list[int]:
        ids, hashes = [], []
        for token in [*SPLIT.findall(text), EOS]:
            kind, own, h = self._token(token)
            if not kind:
                ids += own
                hashes.append(h)
        for i in range(len(hashes)):
            h = hashes[i]
            for x in hashes[i + 1 : i + self.ngrams]:
                h = (h * NGRAM_FACTOR + x) & 0xFFFFFFFFFFFFFFFF
                ids += self._row(h % self.bucket)
        return ids

    def _number(self, token: str) -> int:
        """The token's place in the tables of numbers of features, their sums, and hashes (-1 for labels)."""
        kind, ids, h = self._token(token)
        at = len(self.places)
        if at == len(self.k):
            grown = max(1024, 2 * at)
            self.k, self.hash, self.sums = (np.concatenate([x, np.zeros((grown - at, *x.shape[1:]), x.dtype)]) for x in (self.k, self.hash, self.sums))
        self.k[at], self.hash[at] = len(ids), -1 if kind else h
        self.sums[at] = self.m.input.values[ids].astype(np.float64).sum(0) if ids else 0.0
        self.places[token] = at
        return at

    def _grams(self, x: np.ndarray, of: np.ndarray, total: np.ndarray, n: np.ndarray) -> None:
        """Adds the word n-grams of all texts: x holds token hashes end to end, of the text of each."""
        x = x.astype(np.uint64)
        h, start = x, np.arange(len(x))
        for j in range(1, self.ngrams):
            goes_on = start + j < len(x)
            goes_on[goes_on] = of[start[goes_on]] == of[start[goes_on] + j]
            start = start[goes_on]
            h = h[goes_on] * np.uint64(NGRAM_FACTOR) + x[start + j]
            rows, text = (h % np.uint64(self.bucket)).astype(np.int64), of[start]
            if self.m.prune_size >= 0:
                rows = np.array([self.m.prune.get(r, -1) for r in rows.tolist()], np.int64)
            some = rows >= 0
            np.add.at(total, text[some], self.m.input.values[self.m.nwords + rows[some]])
            n += np.bincount(text[some], minlength=len(n))

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(means in single precision, numbers of features) of the texts."""
        out, counts, group, held = [], [], [], 0
        for tokens in (SPLIT.findall(t) for t in texts):
            group.append(tokens)
            held += len(tokens) + 1
            if held >= BATCH_TOKENS:
                self._flush(group, out, counts)
                group, held = [], 0
        if group:
            self._flush(group, out, counts)
        return (np.concatenate(out), np.concatenate(counts)) if out else (np.zeros((0, self.m.dim), np.float32), np.zeros(0, np.int64))

    def _flush(self, group: list[list[str]], out: list[np.ndarray], counts: list[np.ndarray]) -> None:
        if len(self.places) >= MEMO_TOKENS:
            self._forget()
        flat = [t for tokens in group for t in (*tokens, EOS)]
        for t in set(flat).difference(self.places):
            self._number(t)
        at = np.array(list(map(self.places.__getitem__, flat)), np.int64)
        sizes = np.array([len(t) + 1 for t in group])
        first = np.cumsum(sizes) - sizes
        total, n = np.add.reduceat(self.sums[at], first, axis=0), np.add.reduceat(self.k[at], first)
        if self.ngrams > 1:
            x, of = self.hash[at], np.repeat(np.arange(len(group)), sizes)
            self._grams(x[x >= 0], of[x >= 0], total, n)
        out.append((total / np.maximum(n, 1)[:, None]).astype(np.float32))
        counts.append(n)

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.k, self.hash, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, self.m.dim))

    def vector(self, text: str) -> np.ndarray:
        vectors, n = self.vectors([text])
        if not n[0]:
            raise EmptyInputError("no feature")
        return vectors[0]

    def predict(self, text: str, k: int = 1, threshold: float = 0.0) -> list[tuple[str, float]]:
        found = self.predict_many([text], k, threshold)[0]
        if found is None:
            raise EmptyInputError("no feature")
        return found

    def predict_many(self, texts: list[str], k: int = 1, threshold: float = 0.0) -> list[list[tuple[str, float]] | None]:
        """For each text its labels, or null without features."""
        if self.m.args["model_type"] != 3:
            raise InvalidModelError("only a supervised model has labels")
        h, n = self.vectors(texts)
        k = min(k, len(self.labels))
        if k <= 0:
            return [[] if x else None for x in n.tolist()]
        out: list[list[tuple[str, float]] | None] = [None] * len(texts)
        live = np.flatnonzero(n)
        if self.m.args["loss"] == 1:
            for i in live.tolist():
                heap = BoundedHeap(k)
                self._descend(h[i], threshold, heap)
                out[i] = self._named(heap.ranked())
            return out
        for a in range(0, len(live), step := max(1, (1 << 22) // max(1, len(self.labels)))):
            rows = live[a : a + step]
            z = h[rows] @ self.m.output.values.T
            e = np.exp(z - z.max(1, keepdims=True))
            p = e / e.sum(1, dtype=np.float32, keepdims=True)
            logs = np.log(p.astype(np.float64) + 1e-5)
            logs[p < np.float32(threshold)] = -np.inf
            top = np.argsort(-logs, axis=1, kind="stable")[:, : k + 1]
            best = np.take_along_axis(logs, top, 1)
            tied = (best[:, 1:] == best[:, :-1]).any(1)  # only then the order of the heap matters
            for i, order, scores, ties, all_logs in zip(rows.tolist(), top[:, :k].tolist(), best[:, :k].tolist(), tied.tolist(), logs, strict=True):
                if ties:
                    heap = BoundedHeap(k)
                    for label in np.flatnonzero(all_logs > -np.inf).tolist():
                        heap.offer(float(all_logs[label]), label)
                    out[i] = self._named(heap.ranked())
                else:
                    out[i] = self._named([(s, label) for s, label in zip(scores, order, strict=True) if s > -np.inf])
        return out

    def _named(self, ranked: list[tuple[float, int]]) -> list[tuple[str, float]]:
        return [(self.labels[label], math.exp(s)) for s, label in ranked]

    def _descend(self, h: np.ndarray, threshold: float, heap: BoundedHeap) -> None:
        """Depth first, left before right, without branches that cannot enter the heap or lie below the threshold."""
        least = np.log(threshold + 1e-5) if threshold > 0 else -np.inf
        root = ("leaf", 0) if len(self.labels) == 1 else ("node", len(self.labels) - 2)
        todo = [(root, 0.0)]
        while todo:
            (what, i), score = todo.pop()
            if heap.full_above(score) or score < least:
                continue
            if what == "leaf":
                heap.offer(score, i)
                continue
            x = float(self.m.output.values[i] @ h)
            f = 0.0 if x < -8 else 1.0 if x > 8 else 1 / (1 + np.exp(-x))
            todo.append((self.children[i][True], score + float(np.log(f + 1e-5))))
            todo.append((self.children[i][False], score + float(np.log(1 - f + 1e-5))))


class Functions:
    """The model's SQL functions: predict_labels, sentence_vector, token_ids and the table function predict_table."""

    def __init__(self, spark: SparkSession, model: Model):
        self.spark = spark
        shared = spark.sparkContext.broadcast(model)
        held: dict[str, Predictor] = {}

        def predictor() -> Predictor:
            if "p" not in held:
                held["p"] = Predictor(shared.value)
            return held["p"]

        def safe(f, empty):
            def run(text):
                if text is None:
                    return None
                try:
                    return f(text)
                except EmptyInputError:
                    return empty
            return run

        def some(text: pd.Series) -> tuple[list[int], list[str]]:
            at = [i for i, t in enumerate(text) if t is not None]
            return at, [text.iloc[i] for i in at]

        @F.pandas_udf(PREDICTIONS)
        def predict_labels(text: pd.Series, k: pd.Series, threshold: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(text), dtype=object)
            for (n, least), places in pd.Series(range(len(text))).groupby([k.to_numpy(), threshold.to_numpy()]).groups.items():  # mostly one pair
                at, texts = some(text.iloc[places])
                for i, found in zip(at, predictor().predict_many(texts, int(n), float(least)), strict=True):
                    out.iat[places[i]] = [{"label": a, "probability": b} for a, b in found or []]
            return out

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def sentence_vector(text: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(text), dtype=object)
            at, texts = some(text)
            vectors, n = predictor().vectors(texts)
            for i, v, features in zip(at, vectors, n.tolist(), strict=True):
                out.iat[i] = v if features else None
            return out

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def token_ids(text: pd.Series) -> pd.Series:
            p = predictor()
            return pd.Series([safe(p.line, [])(t) for t in text], dtype=object)

        class PredictTable:
            def eval(self, text: str, k: int, threshold: float) -> Iterator[tuple[int, str, float]]:
                for i, (a, b) in enumerate(safe(lambda t: predictor().predict(t, k, threshold), [])(text) or []):
                    yield i + 1, a, b

        self.predict_labels, self.sentence_vector, self.token_ids = predict_labels, sentence_vector, token_ids
        self.predict_table = F.udtf(PredictTable, returnType="rank int, label string, probability float")

    def register(self, prefix: str = "") -> None:
        for name in ("predict_labels", "sentence_vector", "token_ids"):
            self.spark.udf.register(prefix + name, getattr(self, name))
        self.spark.udtf.register(prefix + "predict_table", self.predict_table)

    def predict(self, df: DataFrame, text_col: str = "text", k: int = 1, threshold: float = 0.0) -> DataFrame:
        return df.withColumn("predictions", self.predict_labels(F.col(text_col), F.lit(k), F.lit(float(threshold))))
