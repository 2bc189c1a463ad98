"""A model as DataFrames: the relations that the plans join with."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from glyphmill.sources.model_file import CENTROIDS, LABEL_PREFIX, Codebook, Matrix, Model

#: A model table is broadcast if it is known to be smaller.
BROADCAST_BYTES = 64 << 20


@dataclass
class ModelFrames:
    """dictionary (id, word, cnt, entry_type), prune (hash_id, remapped), input (row_id, vec), output (label_id, vec),
    labels (label_id, label, cnt), hs_path (label_id, depth, inner_row, is_right); input_bytes decides how input is joined."""

    dim: int
    nwords: int
    loss: int
    bucket: int
    minn: int
    maxn: int
    word_ngrams: int
    prune_size: int
    dictionary: DataFrame
    prune: DataFrame
    input: DataFrame
    output: DataFrame
    labels: DataFrame
    hs_path: DataFrame | None = None
    input_bytes: int = 0
    dictionary_bytes: int = 0
    supervised: bool = True
    #: Entries whose type contradicts their prefix: few, if any.
    odd_words: tuple[str, ...] = ()
    #: One row with all output rows, label names and tree paths, if small enough to be broadcast.
    head: DataFrame | None = None
    #: word, k, vec: number and sum of the input rows of each word, where a model has them ready; and their bytes.
    words: DataFrame | None = None
    words_bytes: int = 0


def head_frame(spark: SparkSession, outputs: list[list[float]], labels: list[str], tree: list[list[tuple[int, bool]]] | None) -> DataFrame | None:
    size = sum(4 * len(v) for v in outputs) + sum(len(x) + 8 for x in labels) + sum(16 * len(p) for p in tree or [])
    if size > BROADCAST_BYTES:
        return None
    return spark.createDataFrame([(outputs, labels, tree)], "outputs array<array<float>>, names array<string>, paths array<array<struct<node:int,goes_right:boolean>>>")


def _vectors(values: np.ndarray, key: str) -> pa.Table:
    flat = pa.array(np.ascontiguousarray(values, np.float32).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), flat) if values.size else pa.array([], pa.list_(pa.float32()))
    return pa.table({key: pa.array(np.arange(len(lists)), pa.int64()), "vec": lists})


def to_frames(spark: SparkSession, model: Model) -> ModelFrames:
    a = model.args
    kinds = model.kinds.tolist()
    words = pa.table({"id": pa.array(range(len(model.words)), pa.int64()), "word": pa.array(model.words, pa.string()), "cnt": pa.array(model.counts, pa.int64()), "entry_type": pa.array(kinds, pa.int32())})
    prune = pa.table({"hash_id": pa.array(list(model.prune), pa.int64()), "remapped": pa.array(list(model.prune.values()), pa.int64())})
    labels = [(i, w, int(c)) for i, (w, c) in enumerate((w, c) for w, c, k in zip(model.words, model.counts, kinds, strict=True) if k == 1)]
    paths = [(label, depth, row, right) for label, path in enumerate(model.tree or []) for depth, (row, right) in enumerate(path)]
    return ModelFrames(
        model.dim, model.nwords, int(a["loss"]), int(a["bucket"]), int(a["minn"]), int(a["maxn"]), int(a["word_ngrams"]), model.prune_size,
        spark.createDataFrame(words), spark.createDataFrame(prune) if model.prune else spark.createDataFrame([], "hash_id bigint, remapped bigint"),
        spark.createDataFrame(_vectors(model.input.values, "row_id")), spark.createDataFrame(_vectors(model.output.values, "label_id")),
        spark.createDataFrame(labels, "label_id bigint, label string, cnt bigint"),
        spark.createDataFrame(paths, "label_id bigint, depth int, inner_row bigint, is_right boolean") if model.tree is not None else None,
        model.input.values.nbytes, sum(len(w.encode()) + 40 for w in model.words), a["model_type"] == 3,
        tuple(w for w, k in zip(model.words, kinds, strict=True) if (k == 1) != w.startswith(LABEL_PREFIX)),
        head_frame(spark, model.output.values.tolist(), model.labels, model.tree),
    )


def codebook_frame(spark: SparkSession, book: Codebook) -> DataFrame:
    """centroids: part, code, vec."""
    rows = [(i, c, book.part(i)[c].tolist()) for i in range(book.parts) for c in range(CENTROIDS)]
    return spark.createDataFrame(rows, "part bigint, code bigint, vec array<float>")


def code_frame(spark: SparkSession, m: Matrix) -> DataFrame:
    """codes: row_id, codes (array), norm_code (null without norms)."""
    norms = m.norm_codes.tolist() if m.norm_codes is not None else [None] * m.rows
    return spark.createDataFrame([(i, m.codes[i].tolist(), norms[i]) for i in range(m.rows)], "row_id bigint, codes array<bigint>, norm_code bigint")
