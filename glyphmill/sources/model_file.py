"""The binary model format, version 12, little-endian: bytes to numpy, on the driver, once per model.

Bytes come from a local path or from any store that Spark reads (``binaryFile``).  Quantised matrices decode to
float rows here, so that one plan serves both encodings; their codes stay available for the join form.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession

from glyphmill.sources.errors import InvalidModelError, ModelIOError, UnsupportedVersionError

#: Fixed values of the format.
MAGIC, VERSION = 793712314, 12
MOST_ARRAY_BYTES, MOST_STRING_BYTES = 1 << 30, 1 << 20
CENTROIDS = 256
EOS, LABEL_PREFIX = "</s>", "__label__"
MODEL_TYPES = {1: "cbow", 2: "skip-gram", 3: "supervised"}
LOSSES = {1: "hierarchical softmax", 2: "negative sampling", 3: "softmax"}
ARGS = ("dim", "ws", "epoch", "min_count", "neg", "word_ngrams", "loss", "model_type", "bucket", "minn", "maxn", "lr_update_rate")


@dataclass
class Codebook:
    """A product quantiser: for each part of a vector, 256 centroids."""

    dim: int
    parts: int
    width: int
    last_width: int
    centroids: np.ndarray

    def part(self, i: int) -> np.ndarray:
        """The (256, width) centroids of a part; the last part has its own width, after all full ones."""
        width = self.last_width if i == self.parts - 1 else self.width
        start = i * CENTROIDS * self.width
        return self.centroids[start : start + CENTROIDS * width].reshape(CENTROIDS, width)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.part(i)[codes[:, i]] for i in range(self.parts)], axis=1)


@dataclass
class Matrix:
    rows: int
    columns: int
    values: np.ndarray
    codes: np.ndarray | None = None
    book: Codebook | None = None
    norm_codes: np.ndarray | None = None
    norm_book: Codebook | None = None


@dataclass
class Model:
    args: dict[str, float]
    words: list[str]
    counts: np.ndarray
    kinds: np.ndarray
    nwords: int
    nlabels: int
    prune_size: int
    prune: dict[int, int]
    input: Matrix
    output: Matrix
    tree: list[list[tuple[int, bool]]] | None = field(default=None)

    @property
    def dim(self) -> int:
        return int(self.args["dim"])

    @property
    def labels(self) -> list[str]:
        return [w for w, k in zip(self.words, self.kinds.tolist(), strict=True) if k == 1]


class Bytes:
    """A cursor over the file's bytes with the format's guards."""

    def __init__(self, data: bytes):
        self.raw, self.data, self.at = bytes(data), memoryview(data), 0

    def take(self, n: int) -> memoryview:
        if self.at + n > len(self.data):
            raise ModelIOError(f"the file ends at {len(self.data)}; {self.at + n} bytes are needed")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def number(self, kind: str):
        return struct.unpack("<" + kind, self.take(struct.calcsize("<" + kind)))[0]

    def size(self, kind: str) -> int:
        n = self.number(kind)
        if n < 0:
            raise InvalidModelError(f"negative size {n}")
        return n

    def string(self) -> str:
        end = self.raw.find(b"\0", self.at, self.at + MOST_STRING_BYTES + 1) - self.at
        if end < 0:
            if len(self.data) - self.at > MOST_STRING_BYTES:
                raise InvalidModelError("a string of more than 1 MiB")
            raise ModelIOError("the file ends inside a string")
        raw = bytes(self.take(end + 1))[:-1]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError as e:
            raise InvalidModelError("a string is not UTF-8") from e

    def array(self, n: int, kind: str) -> np.ndarray:
        kind = np.dtype(kind)
        if n * kind.itemsize > MOST_ARRAY_BYTES:
            raise InvalidModelError("an array of more than 1 GiB")
        return np.frombuffer(self.take(n * kind.itemsize), kind)


def _args(b: Bytes) -> dict[str, float]:
    args: dict[str, float] = {name: b.number("i") for name in ARGS}
    args["t"] = b.number("d")
    for name, known in (("loss", LOSSES), ("model_type", MODEL_TYPES)):
        if args[name] not in known:
            raise InvalidModelError(f"unknown {name} {args[name]}")
    if args["word_ngrams"] < 0:
        raise InvalidModelError("negative word_ngrams")
    if args["dim"] < 0:
        raise InvalidModelError("negative dim")
    if args["bucket"] <= 0 and (args["word_ngrams"] > 1 or args["maxn"] > 0):
        raise InvalidModelError("n-grams need a bucket")
    return args


def _codebook(b: Bytes) -> Codebook:
    dim, parts, width, last = (b.size("i") for _ in range(4))
    book = Codebook(dim, parts, width, last, b.array(dim * CENTROIDS, "<f4"))
    if parts < 1 or (parts - 1) * width + last != dim:
        raise InvalidModelError("the codebook's parts do not add up")
    return book


def _dense(b: Bytes) -> Matrix:
    m, n = b.size("q"), b.size("q")
    return Matrix(m, n, b.array(m * n, "<f4").reshape(m, n))


def _quantised(b: Bytes) -> Matrix:
    normed = b.number("B") != 0
    m, n, size = b.size("q"), b.size("q"), b.size("i")
    raw = b.array(size, "u1")
    book = _codebook(b)
    if size != m * book.parts or book.dim != n:
        raise InvalidModelError("codes do not fit the matrix")
    codes = raw.reshape(m, book.parts)
    values = book.decode(codes)
    norm_codes = norm_book = None
    if normed:
        norm_codes, norm_book = b.array(m, "u1"), _codebook(b)
        values = values * norm_book.part(0)[norm_codes, 0][:, None]
    return Matrix(m, n, values.astype(np.float32), codes, book, norm_codes, norm_book)


def huffman(counts: list[int]) -> list[list[tuple[int, bool]]]:
    """For each label its path from the root: (row of the output matrix, goes right).

    Labels come by count, falling, so leaves are taken from the end and merged nodes in the order they were made; of
    equal counts the merged node goes first, the first taken becomes the left child.
    """
    n = len(counts)
    if n == 0:
        raise InvalidModelError("hierarchical softmax without labels")
    weight, parent, right = list(counts), [-1] * (2 * n - 1), [False] * (2 * n - 1)
    leaf, inner = n - 1, n
    for new in range(n, 2 * n - 1):
        pair = []
        for _ in range(2):
            use_leaf = leaf >= 0 and (inner >= len(weight) or weight[leaf] < weight[inner])
            pair.append(leaf if use_leaf else inner)
            if use_leaf:
                leaf -= 1
            else:
                inner += 1
        parent[pair[0]] = parent[pair[1]] = new
        right[pair[1]] = True
        weight.append(weight[pair[0]] + weight[pair[1]])
    paths = []
    for i in range(n):
        path = []
        while parent[i] >= 0:
            path.append((parent[i] - n, right[i]))
            i = parent[i]
        paths.append(path[::-1])
    return paths


def parse(data: bytes) -> Model:
    b = Bytes(data)
    if b.number("i") != MAGIC:
        raise InvalidModelError("not a model file")
    if (version := b.number("i")) != VERSION:
        raise UnsupportedVersionError(VERSION, version)
    args = _args(b)
    size, nwords, nlabels = b.size("i"), b.size("i"), b.size("i")
    b.number("q")
    prune_size = b.number("q")
    words, counts, kinds = [], [], []
    for _ in range(size):
        words.append(b.string())
        counts.append(b.number("q"))
        kinds.append(b.number("B"))
        if kinds[-1] > 1:
            raise InvalidModelError(f"entry type {kinds[-1]}")
    prune = dict(struct.unpack("<ii", b.take(8)) for _ in range(max(prune_size, 0)))
    quantised = b.number("B") != 0
    inputs = _quantised(b) if quantised else _dense(b)
    output_quantised = b.number("B") != 0
    outputs = _quantised(b) if quantised and output_quantised else _dense(b)
    model = Model(args, words, np.array(counts, np.int64), np.array(kinds, np.int8), nwords, nlabels, prune_size, prune, inputs, outputs)
    _validate(model)
    if args["loss"] == 1:
        model.tree = huffman([c for c, k in zip(counts, kinds, strict=True) if k == 1][: outputs.rows])
    return model


def _validate(m: Model) -> None:
    kinds = m.kinds.tolist()
    if kinds.count(0) != m.nwords or kinds.count(1) != m.nlabels:
        raise InvalidModelError("word and label counts do not fit the entries")
    if m.nwords and any(kinds[: m.nwords]):
        raise InvalidModelError("labels must follow words")
    if m.input.columns != m.dim or (m.output.rows and m.output.columns != m.dim):
        raise InvalidModelError("matrix widths do not fit dim")
    grams = m.args["maxn"] > 0 or m.args["word_ngrams"] > 1
    rows = m.nwords + (0 if not grams or m.prune_size == 0 else m.args["bucket"] if m.prune_size < 0 else max([*m.prune.values(), -1]) + 1)
    if m.input.rows < rows or any(v < 0 for v in m.prune.values()):
        raise InvalidModelError("the input matrix has too few rows")
    if m.args["loss"] == 1 and m.output.rows == 0:
        raise InvalidModelError("hierarchical softmax without labels")
    if m.args["model_type"] == 3 and m.output.rows != m.nlabels:
        raise InvalidModelError("the output matrix needs a row for each label")
    if not (np.isfinite(m.input.values).all() and np.isfinite(m.output.values).all()):
        raise InvalidModelError("a weight is not finite")


def load(path: str) -> Model:
    """A model from a local file."""
    try:
        with open(path, "rb") as f:
            return parse(f.read())
    except OSError as e:
        raise ModelIOError(str(e)) from e


def load_spark(spark: SparkSession, path: str) -> Model:
    """A model from any store that Spark reads."""
    rows = spark.read.format("binaryFile").load(path).select("content").take(1)
    if not rows:
        raise ModelIOError(f"nothing at {path}")
    return parse(bytes(rows[0][0]))
