"""Models made from a corpus by counting, for queries and tests: no weights are shipped, and training is out of scope.

Every weight is a small multiple of a power of two, so sums are exact in any order.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import columns as C
from glyphmill.sources.frames import ModelFrames, head_frame
from glyphmill.sources.model_file import ARGS, CENTROIDS, EOS, MAGIC, VERSION, Codebook, Matrix, Model, huffman
from glyphmill.sources.shared import Scratch

VOCABULARY, BUCKET, DIM = 2000, 3000, 8
MOST_LABELS = 1000


def input_weight(r: int, d: int) -> float:
    return ((31 * r + 17 * d + (r * d) % 7) % 65 - 32) / 64


def output_weight(label: int, d: int) -> float:
    return ((13 * label + 29 * d) % 33 - 16) / 16


def vocabulary(docs: DataFrame, size: int = VOCABULARY) -> list[tuple[str, int]]:
    """The end token, then the most frequent other tokens (count falling, then token): size bounds what is collected."""
    counts = docs.select(F.explode(C.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    first = (F.col("token") == EOS).cast("int")
    top = [(r.token, int(r.n)) for r in counts.orderBy(F.desc(first), F.desc("n"), "token").limit(size + 1).collect()]
    return top if top and top[0][0] == EOS else [(EOS, 0), *top[:size]]


def languages(docs: DataFrame) -> list[tuple[str, int]]:
    """Languages and their documents, count falling, then name.  They become labels, so a column with too many is an error."""
    rows = docs.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").take(MOST_LABELS + 1)
    if len(rows) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} languages: not a label column")
    return [(r.lang, int(r.n)) for r in rows]


def codebook(parts: int, width: int, last: int, seed: int) -> Codebook:
    values = [((c * 7 + i * 5 + j * 3 + seed) % 33 - 16) / 16 for i in range(parts) for c in range(CENTROIDS) for j in range(last if i == parts - 1 else width)]
    return Codebook((parts - 1) * width + last, parts, width, last, np.array(values, np.float32))


#: Parts and their width in the quantised input of formula models.
Q_PARTS, Q_WIDTH = 4, 2


def formula_model(docs: DataFrame, maxn: int = 0, minn: int = 0, word_ngrams: int = 1, loss: int = 3, prune_size: int = -1, size: int = VOCABULARY, labels: int | None = None, quantised: bool = False) -> Model:
    """Weights by formula over a counted vocabulary; labels are the languages by count, or so many numbered ones with counts
    that halve (as long as they are integers)."""
    words = vocabulary(docs, size)
    langs = [(f"__label__{lang}", n) for lang, n in languages(docs)] if labels is None else [(f"__label__{i}", max(1, 1 << 60 >> i)) for i in range(labels)]
    entries = words + langs
    grams = maxn > 0 or word_ngrams > 1
    rows = len(words) + (BUCKET if grams else 0)
    r, d = np.arange(rows)[:, None], np.arange(DIM)[None]
    inputs = (((31 * r + 17 * d + (r * d) % 7) % 65 - 32) / 64).astype(np.float32)
    r = np.arange(len(langs))[:, None]
    outputs = (((13 * r + 29 * d) % 33 - 16) / 16).astype(np.float32)
    prune = {h: h // 2 for h in range(0, BUCKET, 2)} if prune_size > 0 else {}
    args = dict(dim=DIM, ws=5, epoch=1, min_count=1, neg=5, word_ngrams=word_ngrams, loss=loss, model_type=3, bucket=BUCKET, minn=minn, maxn=maxn, lr_update_rate=100, t=0.0)
    inputs = Matrix(rows, DIM, inputs)
    if quantised:
        r, i = np.arange(rows)[:, None], np.arange(Q_PARTS)[None]
        codes, book = ((r * 11 + i * 3) % 256).astype(np.uint8), codebook(Q_PARTS, Q_WIDTH, Q_WIDTH, 0)
        norm_codes, norm_book = ((np.arange(rows) * 5) % 256).astype(np.uint8), codebook(1, 1, 1, 4)
        inputs = Matrix(rows, DIM, (book.decode(codes) * norm_book.part(0)[norm_codes, 0][:, None]).astype(np.float32), codes, book, norm_codes, norm_book)
    return Model(
        args, [w for w, _ in entries], np.array([c for _, c in entries], np.int64), np.array([0] * len(words) + [1] * len(langs), np.int8),
        len(words), len(langs), len(prune) if prune_size > 0 else prune_size, prune,
        inputs, Matrix(len(langs), DIM, outputs), huffman([c for _, c in langs]) if loss == 1 else None,
    )


def file_bytes(m: Model) -> bytes:
    """The model as a file of the format, with a dense output matrix."""
    a = m.args
    out = [struct.pack("<2i", MAGIC, VERSION), struct.pack("<12id", *[int(a[x]) for x in ARGS], a["t"])]
    out.append(struct.pack("<3i2q", len(m.words), m.nwords, m.nlabels, int(m.counts.sum()), m.prune_size))
    out += [w.encode() + b"\0" + struct.pack("<qB", int(c), int(k)) for w, c, k in zip(m.words, m.counts, m.kinds, strict=True)]
    out += [struct.pack("<2i", *pair) for pair in m.prune.items()]

    def book(b: Codebook) -> bytes:
        return struct.pack("<4i", b.dim, b.parts, b.width, b.last_width) + b.centroids.astype("<f4").tobytes()

    def dense(x: Matrix) -> bytes:
        return struct.pack("<2q", x.rows, x.columns) + x.values.astype("<f4").tobytes()

    i = m.input
    if i.codes is None:
        return b"".join([*out, b"\0", dense(i), b"\0", dense(m.output)])
    codes = struct.pack("<B2qi", i.norm_codes is not None, i.rows, i.columns, i.codes.size) + i.codes.tobytes() + book(i.book)
    norms = i.norm_codes.tobytes() + book(i.norm_book) if i.norm_codes is not None else b""
    return b"".join([*out, b"\1", codes, norms, b"\0", dense(m.output)])


def count_frames(spark: SparkSession, docs: DataFrame) -> ModelFrames:
    """Language counts per token, over all documents, as a model: a token's vector is floor(64 * share of each language) / 64.

    One pass over the texts writes the counts; a null token counts the documents of a language.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    tokens = known.select("lang", F.explode(F.concat(C.tokens(F.col("text")), F.array(F.lit(None).cast("string")))).alias("token"))
    scratch = Scratch(spark, "counted")
    counts = scratch.keep("counts", tokens.groupBy("token", "lang").agg(F.count("*").alias("n")))
    langs = [(r.lang, r.n) for r in counts.where("token IS NULL").orderBy(F.desc("n"), "lang").select("lang", "n").take(MOST_LABELS + 1)]
    if len(langs) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} languages: not a label column")
    wide = counts.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"l{i}") for i, (lang, _) in enumerate(langs)])
    wide = wide.select(F.col("token").alias("word"), "all", F.array(*[F.floor(64 * F.col(f"l{i}") / F.col("all")) / 64 for i in range(len(langs))]).alias("vec"))
    wide = scratch.keep("words", wide)
    size = wide.agg(F.coalesce(F.sum(F.octet_length("word") + 48 + 8 * len(langs)), F.lit(0))).first()[0]
    # ids are hashes, so that no task numbers the whole vocabulary; negative ones are shifted to stay known
    named = wide.withColumn("id", F.xxhash64("word").bitwiseAND(F.lit((1 << 62) - 1).cast("long")))
    labels = [(i, f"__label__{lang}", n) for i, (lang, n) in enumerate(langs)]
    outputs = [[8.0 * (i == j) for j in range(len(langs))] for i in range(len(langs))]
    return ModelFrames(
        len(langs), 0, 3, 1, 0, 0, 1, -1,
        named.select("id", "word", F.col("all").alias("cnt"), F.lit(0).alias("entry_type")),
        spark.createDataFrame([], "hash_id bigint, remapped bigint"), named.select(F.col("id").alias("row_id"), F.col("vec").cast("array<float>").alias("vec")),
        spark.createDataFrame(list(enumerate(outputs)), "label_id bigint, vec array<float>"), spark.createDataFrame(labels, "label_id bigint, label string, cnt bigint"),
        head=head_frame(spark, outputs, [name for _, name, _ in labels], None), words=wide.select("word", F.lit(1).cast("long").alias("k"), "vec"), words_bytes=size,
    )
