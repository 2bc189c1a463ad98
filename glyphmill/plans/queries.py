"""The registered queries: each applies an operator of this engine to whole tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import columns as C
from glyphmill.functions.vectorised import Functions
from glyphmill.operators import features as X
from glyphmill.operators import scoring as S
from glyphmill.plans import models
from glyphmill.sources.frames import ModelFrames, codebook_frame, code_frame, to_frames
from glyphmill.sources.model_file import CENTROIDS, Codebook, Matrix, huffman, load_spark
from glyphmill.sources.shared import Scratch

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def frames(spark: SparkSession, d: str, **options) -> ModelFrames:
    return to_frames(spark, models.formula_model(docs(spark, d), **options))


@query
def t01_tokenize(spark, d):
    return docs(spark, d).select("doc_id", F.size(C.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query
def t02_end_token(spark, d):
    rows = X.token_rows(docs(spark, d), "doc_id", "text").groupBy("doc_id").agg(F.max(F.struct("pos", "token")).alias("m"))
    return rows.select("doc_id", F.col("m.pos").cast("long").alias("pos"), "m.token")


def _distinct_tokens(spark, d):
    return X.token_rows(docs(spark, d), "doc_id", "text").select("token").distinct()


@query
def t03_fnv1a(spark, d):
    return _distinct_tokens(spark, d).select("token", C.fnv1a(F.col("token")).alias("h"))


@query
def t04_vocab_lookup(spark, d):
    rows = X.lookup(X.token_rows(docs(spark, d), "doc_id", "text"), frames(spark, d))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("id") >= 0).alias("n_known"), F.count_if(F.col("id") < 0).alias("n_oov"))


@query
def t05_token_routing(spark, d):
    text = F.concat_ws(" ", "text", F.concat(F.lit("__label__"), F.col("lang")), F.concat(F.lit("__label__x"), F.col("doc_id").cast("string")))
    rows = X.lookup(X.token_rows(docs(spark, d).withColumn("text", text), "doc_id", "text"), frames(spark, d))
    part = F.count_if
    label = F.col("entry_type") == 1
    return rows.groupBy("doc_id").agg(part(~label).alias("n_word"), part(label & (F.col("id") >= 0)).alias("n_label_known"), part(label & (F.col("id") < 0)).alias("n_label_unknown"))


@query
def t06_char_ngrams(spark, d):
    buckets = C.subword_buckets(F.col("token"), 2, 4, models.BUCKET)
    rows = _distinct_tokens(spark, d).where("token <> '</s>'").select("token", buckets.alias("h"))
    return rows.where(F.size("h") > 0).select("token", F.size("h").cast("long").alias("n_grams"), F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s + x).alias("sum_bucket"))


@query
def t07_markers(spark, d):
    return _distinct_tokens(spark, d).where("token <> '</s>'").select("token", C.fnv1a(F.concat(F.lit("<"), F.col("token"), F.lit(">"))).alias("h"))


@query
def t08_prune_remap(spark, d):
    out = None
    for mode, size in (("all", -1), ("none", 0), ("some", 1)):
        m = frames(spark, d, minn=3, maxn=3, prune_size=size)
        hashes = spark.range(models.BUCKET).select(F.lit(mode).alias("mode"), F.col("id").alias("h"))
        got = X.remap(hashes, m).agg(F.count("*").alias("n_emitted"), F.coalesce(F.sum("row_id"), F.lit(0)).alias("sum_id")).select(F.lit(mode).alias("mode"), "n_emitted", "sum_id")
        out = got if out is None else out.union(got)
    return out


@query
def t09_token_ids(spark, d):
    """All tokens: those of the vocabulary with their own id, the others with subwords alone."""
    rows = X.token_ids(_distinct_tokens(spark, d), frames(spark, d, minn=3, maxn=4))
    return rows.groupBy("token").agg(F.count("*").alias("n_ids"), F.sum("row_id").alias("sum_ids"))


def _word_ngrams(spark, d, n):
    rows = X.word_ngram_buckets(docs(spark, d), frames(spark, d, word_ngrams=n))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("h").alias("sum_bucket"))


@query
def t11_word_bigrams(spark, d):
    return _word_ngrams(spark, d, 2)


@query
def t11_word_trigrams(spark, d):
    return _word_ngrams(spark, d, 3)


@query
def t12_features(spark, d):
    return X.features(docs(spark, d), frames(spark, d))


@query
def t12_line_labels(spark, d):
    text = F.concat_ws(" ", "text", F.concat(F.lit("__label__"), F.col("lang")))
    return X.line_labels(docs(spark, d).withColumn("text", text), frames(spark, d))


@query
def t13_labels(spark, d):
    return frames(spark, d).labels.select("label_id", "label")


@query
def t14_label_counts(spark, d):
    return frames(spark, d).labels


@query
def t15_dim(spark, d):
    return spark.createDataFrame([(frames(spark, d).dim,)], "dim bigint")


def _hidden(spark, d, m=None):
    return S.text_vectors(docs(spark, d), m or frames(spark, d)).where("n > 0")


def _six(x):
    """Six digits; the offset keeps sums of sixty-fourths off the ties, which the two engines round differently."""
    return F.round(x + 1e-9, 6)


@query
def a01_sentence_vector(spark, d):
    return _hidden(spark, d).select("doc_id", F.posexplode("hidden").alias("d", "v")).select("doc_id", F.col("d").cast("long").alias("d"), _six(F.col("v")).alias("value"))


@query
def r12_subword_vector(spark, d):
    rows = _hidden(spark, d, frames(spark, d, minn=3, maxn=3)).select("doc_id", F.posexplode("hidden").alias("d", "v"))
    return rows.select("doc_id", F.col("d").cast("long").alias("d"), _six(F.col("v")).alias("value"))


@query
def m02_dot(spark, d):
    m = frames(spark, d)
    return S.scores(_hidden(spark, d, m), m).select("doc_id", "label_id", _six(F.col("score")).alias("score"))


PARTS, WIDTH, LAST, QUANTISED_ROWS = 3, 3, 2, 200


def quantised_matrix() -> Matrix:
    codes = np.array([[(r * 11 + i * 3) % 256 for i in range(PARTS)] for r in range(QUANTISED_ROWS)], np.uint8)
    norms = np.array([(r * 5) % 256 for r in range(QUANTISED_ROWS)], np.uint8)
    return Matrix(QUANTISED_ROWS, (PARTS - 1) * WIDTH + LAST, np.zeros((0, 0), np.float32), codes, models.codebook(PARTS, WIDTH, LAST, 0), norms, models.codebook(1, 1, 1, 4))


def _decoded(spark):
    m = quantised_matrix()
    return S.decode_rows(code_frame(spark, m), codebook_frame(spark, m.book), codebook_frame(spark, m.norm_book))


@query
def m04_pq_decode(spark, d):
    return _decoded(spark).select("row_id", F.posexplode("vec").alias("d", "v")).select("row_id", F.col("d").cast("long").alias("d"), F.round(F.col("v").cast("double"), 6).alias("value"))


@query
def m05_pq_dot(spark, d):
    query_vector = F.array(*[F.lit((j % 5 - 2) / 4) for j in range((PARTS - 1) * WIDTH + LAST)])
    return _decoded(spark).select("row_id", F.round(C.dot(F.col("vec"), query_vector), 6).alias("score"))


@query
def m06_row_norm(spark, d):
    m = quantised_matrix()
    norms = codebook_frame(spark, m.norm_book).where("part = 0").select(F.col("code").alias("norm_code"), F.get("vec", F.lit(0)).cast("double").alias("norm"))
    return code_frame(spark, m).join(F.broadcast(norms), "norm_code").select("row_id", "norm")


def _softmax(spark, d):
    m = frames(spark, d)
    rows = S.score_array(_hidden(spark, d, m), m).select("doc_id", F.arrays_zip(F.col("names").alias("label"), S.softmax_array(F.col("z")).alias("prob")).alias("p"))
    return rows.select("doc_id", F.explode("p").alias("p")).select("doc_id", "p.label", "p.prob")


@query
def r01_softmax(spark, d):
    return _softmax(spark, d).select("doc_id", "label", F.round("prob", 6).alias("prob"))


@query
def r02_biased_log(spark, d):
    return docs(spark, d).select("doc_id", F.round(C.std_log(F.col("n_chars") / 1000), 6).alias("y"))


@query
def r03_sigmoid(spark, d):
    x = (F.col("n_chars") % 401 - 200) / 20
    return docs(spark, d).select("doc_id", F.round(C.sigmoid(x), 6).alias("y"))


def _top(spark, d, k, threshold=0.0, **options):
    m = frames(spark, d, **options)
    return S.predict_rows(docs(spark, d), m, k, threshold).select("doc_id", F.col("rank").cast("long").alias("rank"), "label", F.round("prob", 6).alias("prob"))


@query
def r05_topk(spark, d):
    return _top(spark, d, 3)


@query
def r05_threshold(spark, d):
    return _top(spark, d, 4, 0.3)


@query
def r04_hierarchical(spark, d):
    return _top(spark, d, 4, loss=1).select("doc_id", "label", "prob")


@query
def s19_huffman(spark, d):
    labels = frames(spark, d).labels.orderBy("label_id").collect()
    paths = huffman([r.cnt for r in labels])
    return spark.createDataFrame([(r.label, len(p)) for r, p in zip(labels, paths, strict=True)], "label string, depth bigint")


def _top1(spark, d):
    m = models.count_frames(spark, docs(spark, d))
    return S.predict_rows(docs(spark, d), m, 1).select("doc_id", "label", F.round("prob", 6).alias("prob"))


@query
def r11_predict_top1(spark, d):
    """The flagship: the language of every document."""
    return _top1(spark, d)


def _judged(spark, d):
    return _top1(spark, d).join(docs(spark, d).select("doc_id", F.concat(F.lit("__label__"), "lang").alias("expected")), "doc_id")


def _held_out(spark, d):
    """The model counts documents of odd ids and is judged on the others (the split is the workload's, not a cap)."""
    known = docs(spark, d)
    m = models.count_frames(spark, known.where("doc_id % 2 = 1"))
    rows = S.predict_rows(known.where("doc_id % 2 = 0"), m, 1).select("doc_id", "label")
    return rows.join(known.select("doc_id", F.concat(F.lit("__label__"), "lang").alias("expected")), "doc_id")


@query
def w01_precision(spark, d):
    return _held_out(spark, d).agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("expected")).cast("int")), 6).alias("precision_at_1"))


@query
def w02_failures(spark, d):
    return _held_out(spark, d).where("label <> expected").select("doc_id", "expected", "label")


#: W03: short sentences, taken in turn, by a quantised model of MANY labels.
SENTENCES = ("the cat sat on the mat", "le chat est sur la table", "der Hund und die Katze", "el gato en la casa", "a short line of text")
MANY, ROUNDS = 176, 10_000


def sentence_rows(spark, n=ROUNDS):
    return spark.range(n).select("id", F.get(F.array(*[F.lit(x) for x in SENTENCES]), (F.col("id") % len(SENTENCES)).cast("int")).alias("text"))


def many_labels(spark, d, **options):
    """A model of MANY labels whose vocabulary is counted, as a file of the format that is written and loaded again."""
    model = models.formula_model(docs(spark, d), labels=MANY, quantised=True, **options)
    path = Scratch(spark, "model").put("model.bin", models.file_bytes(model))
    return load_spark(spark, path)


@query
def w03_throughput(spark, d):
    rows = Functions(spark, many_labels(spark, d)).predict(sentence_rows(spark)).select("text", F.get("predictions", F.lit(0)).alias("p"))
    return rows.groupBy("text", "p.label").agg(F.count("*").alias("n"))


@query
def m09_quantised_predict(spark, d):
    """A quantised model file from end to end."""
    rows = S.predict_rows(docs(spark, d), to_frames(spark, many_labels(spark, d)), 1)
    return rows.select("doc_id", "label", F.round("prob", 6).alias("prob"))


@query
def r06_tie_order(spark, d):
    """Equal scores through the heap: k of four labels that all score alike."""
    model = models.formula_model(docs(spark, d), labels=4)
    model.output.values = np.zeros_like(model.output.values)
    f = Functions(spark, model)
    rows = spark.range(1, 6).select(F.col("id").alias("k"), f.predict_labels(F.lit("the"), F.col("id").cast("int"), F.lit(0.0)).alias("p"))
    return rows.select("k", F.array_join(F.transform("p", lambda x: F.substring(x["label"], -1, 1)), ",").alias("labels"))


@query
def r04_deep_tree(spark, d):
    """The best three of MANY labels by the tree, whose labels have counts of powers of two: one path goes through all inner nodes."""
    model = models.formula_model(docs(spark, d), labels=40, loss=1)
    rows = S.predict_rows(docs(spark, d), to_frames(spark, model), 3)
    return rows.select("doc_id", F.col("rank").cast("long").alias("rank"), "label", F.round("prob", 6).alias("prob"))


@query
def w04_agreement(spark, d):
    a = _top(spark, d, 1).select("doc_id", F.col("label").alias("a"))
    return a.join(_top1(spark, d).select("doc_id", F.col("label").alias("b")), "doc_id").agg(F.count("*").alias("n"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("agree"))


@query
def w05_vector_close(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    moved = F.transform("embedding", lambda x: (x.cast("double") + F.when(F.col("vec_id") % 2 == 0, 0.00005).otherwise(0.0002)))
    return e.select("vec_id", C.close(F.col("embedding"), moved, 1e-4).alias("close"))


@query
def w06_prob_close(spark, d):
    return _softmax(spark, d).select("doc_id", "label", C.near_relative(F.round("prob", 2), F.round("prob", 6), 0.02).alias("close"))


@query
def w07_sorted(spark, d):
    w = Window.partitionBy("doc_id").orderBy("rank")
    rows = _top(spark, d, 4).withColumn("before", F.lag("prob").over(w))
    return rows.groupBy("doc_id").agg(F.min(F.coalesce(F.col("prob") <= F.col("before"), F.lit(True))).alias("sorted"))


@query
def w08_topk_sweep(spark, d):
    model = models.formula_model(docs(spark, d), labels=MANY)
    rows = S.predict_rows(docs(spark, d), to_frames(spark, model), MANY).select("doc_id", "rank", "prob")
    ks = F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 5, 10, 50, MANY)])).alias("k")
    return rows.select("rank", "prob", ks).where("rank <= k").groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 5).alias("avg_prob"))


@query
def w09_by_length(spark, d):
    bucket = F.when(F.col("n_chars") < 100, "short").when(F.col("n_chars") < 800, "medium").otherwise("long")
    rows = _top1(spark, d).join(docs(spark, d).select("doc_id", bucket.alias("bucket")), "doc_id")
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 5).alias("avg_prob"))


@query
def w10_by_lang(spark, d):
    rows = _top1(spark, d).join(docs(spark, d).select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 5).alias("avg_prob"))


def _functions(spark, d):
    return Functions(spark, models.formula_model(docs(spark, d)))


@query
def v_predict_udf(spark, d):
    rows = _functions(spark, d).predict(docs(spark, d)).select("doc_id", F.get("predictions", F.lit(0)).alias("p"))
    return rows.select("doc_id", "p.label", F.round(F.col("p.probability").cast("double"), 4).alias("prob"))


@query
def v_embed_udf(spark, d):
    rows = docs(spark, d).select("doc_id", F.posexplode(_functions(spark, d).sentence_vector("text")).alias("d", "v"))
    return rows.select("doc_id", F.col("d").cast("long").alias("d"), F.round(F.col("v").cast("double") + 1e-6, 4).alias("value"))


@query
def v_token_ids(spark, d):
    ids = _functions(spark, d).token_ids("text")
    rows = docs(spark, d).select("doc_id", ids.alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("sum_ids"))


@query
def v_predict_udtf(spark, d):
    _functions(spark, d).register("glyphmill_")
    docs(spark, d).createOrReplaceTempView("glyphmill_documents")
    return spark.sql("SELECT doc_id, p.label, round(CAST(p.probability AS DOUBLE), 4) AS prob FROM glyphmill_documents, LATERAL glyphmill_predict_table(text, 1, 0.0D) AS p")


@query
def v_stream_predict(spark, d):
    from glyphmill.streaming.predict import predict_stream, run_to_end

    out = Scratch(spark, "stream").root
    functions = _functions(spark, d)
    stream = spark.readStream.schema(docs(spark, d).schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/documents.parquet")
    run_to_end(predict_stream(stream, functions), f"{out}/rows", f"{out}/state")
    rows = spark.read.parquet(f"{out}/rows").select("doc_id", F.get("predictions", F.lit(0)).alias("p"))
    return rows.select("doc_id", "p.label", F.round(F.col("p.probability").cast("double"), 4).alias("prob"))


@query
def s05_format_roundtrip(spark, d):
    """A model file written to the shared folder and loaded again: sizes and sums of its sections."""
    model = many_labels(spark, d, minn=3, maxn=3)
    sections = [
        ("args", len(model.args), sum(int(v) for v in model.args.values())), ("dictionary", len(model.words), int(model.counts.sum())), ("labels", model.nlabels, sum(map(len, model.labels))),
        ("codes", model.input.rows, int(model.input.codes.astype(np.int64).sum())), ("output", model.output.rows, int((model.output.values * 16).sum())),
    ]
    return spark.createDataFrame([(a, int(b), int(c)) for a, b, c in sections], "section string, n bigint, total bigint")


def oracles() -> dict[str, str]:
    from glyphmill.plans.oracles import oracles as sql

    return sql()
