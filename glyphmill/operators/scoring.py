"""Feature ids to vectors, scores and ranked labels, as relations.

A text's vector is one grouped sum over its tokens, with partial sums before the only shuffle; scores, softmax, tree and ranking are then
expressions over arrays in the text's row.  A model whose output rows are too large to be broadcast has a row for each text and label instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import columns as C
from glyphmill.operators import features as X
from glyphmill.operators.skew import spread_join
from glyphmill.sources.errors import InvalidModelError
from glyphmill.sources.frames import BROADCAST_BYTES, ModelFrames
from glyphmill.sources.shared import Scratch


def _sums(m: ModelFrames, times: Column, vec: str) -> list[Column]:
    return [F.sum(times * F.get(vec, F.lit(d)).cast("double")).alias(f"s{d}") for d in range(m.dim)]


def _input(m: ModelFrames) -> DataFrame:
    return F.broadcast(m.input) if 0 < m.input_bytes <= BROADCAST_BYTES else m.input


def _per(rows: DataFrame, key: str, m: ModelFrames) -> DataFrame:
    """key, k, vec: number and sum of the input rows that rows (key, row_id) name."""
    total = rows.join(_input(m), "row_id").groupBy(key).agg(F.count("*").alias("k"), *_sums(m, F.lit(1.0), "vec"))
    return total.select(key, "k", F.array(*[F.col(f"s{d}") for d in range(m.dim)]).alias("vec"))


def word_vectors(m: ModelFrames) -> tuple[DataFrame, int]:
    """(word, k, vec of the vocabulary's words; bytes or 0): a token of a text is then one lookup."""
    if m.words is not None:
        return m.words, m.words_bytes
    if m.maxn > 0:
        table = _per(X.word_ids(m), "word", m)
    else:
        rows = X.word_ids(m).join(_input(m), "row_id")
        table = rows.select("word", F.lit(1).cast("long").alias("k"), F.col("vec").cast("array<double>").alias("vec"))
    return table, m.dictionary_bytes + 8 * m.dim * m.nwords if m.dictionary_bytes else 0


def text_vectors(df: DataFrame, m: ModelFrames, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, sums, hidden for every id: number of features (null for null texts), the sum of their vectors and its mean (null without features)."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.explode_outer(C.tokens(F.col(text_col))).alias("token"))
    table, size = word_vectors(m)
    whole = F.when(F.col("token").isNotNull(), F.coalesce("k", F.lit(0).cast("long")))
    parts = [X.with_table(rows, table, size).select("doc_id", whole.alias("k"), F.lit(1).cast("long").alias("cnt"), "vec")]
    if m.maxn > 0:  # unknown tokens: subwords once per distinct token
        odd = X.unknown_tokens(rows.where("token IS NOT NULL"), m, m.dictionary_bytes, X.vocabulary(m).select("word"))
        odd = Scratch(df.sparkSession, "unknown").keep("tokens", odd)  # read more than once
        each = _per(X.subword_ids(odd.select("token").distinct(), m), "token", m)
        parts.append(spread_join(odd, ["token"], "doc_id", each).select("doc_id", "k", "cnt", "vec"))
    if m.word_ngrams > 1:
        grams = X.remap(X.word_ngram_buckets(df, m, id_col, text_col), m).join(_input(m), "row_id")
        parts.append(grams.select("doc_id", F.lit(1).cast("long").alias("k"), F.lit(1).cast("long").alias("cnt"), F.col("vec").cast("array<double>").alias("vec")))
    total = reduce(DataFrame.union, parts).groupBy("doc_id").agg(F.sum(F.col("k") * F.col("cnt")).alias("n"), *_sums(m, F.col("cnt"), "vec"))
    sums = F.array(*[F.coalesce(F.col(f"s{d}"), F.lit(0.0)) for d in range(m.dim)])
    rows = total.select("doc_id", "n", F.when(F.col("n") > 0, sums).alias("sums"))
    return rows.withColumn("hidden", F.transform("sums", lambda x: x / F.col("n")))


def hidden(rows: DataFrame, m: ModelFrames) -> DataFrame:
    """doc_id, hidden: the mean of the feature rows (doc_id, row_id, cnt); texts without features have no row."""
    total = rows.join(_input(m), "row_id").groupBy("doc_id").agg(F.sum("cnt").alias("n"), *_sums(m, F.col("cnt"), "vec"))
    return total.select("doc_id", F.array(*[F.col(f"s{d}") / F.col("n") for d in range(m.dim)]).alias("hidden"))


def _score(output: Column) -> Column:
    """The mean's dot product with an output row, divided last: where the sums are exact, equal scores are then equal as numbers, too."""
    return C.dot(F.col("sums"), output) / F.col("n")


def score_array(vectors: DataFrame, m: ModelFrames) -> DataFrame:
    """vectors with z: the dot products with all output rows, and names and paths of the labels."""
    rows = vectors.crossJoin(F.broadcast(m.head))  # one row, below BROADCAST_BYTES
    return rows.select(*vectors.columns, F.transform("outputs", _score).alias("z"), "names", "paths")


def softmax_array(z: Column) -> Column:
    """Probabilities, shifted by the greatest score."""
    shifted = lambda s: C.let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
    return C.let(C.let(z, shifted), lambda e: C.let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total)))


def tree_array(z: Column, paths: Column) -> Column:
    """Log-probability of each label: each inner node's two branches once, then sums along the paths; one label alone has 0."""
    def of(branches: Column) -> Column:
        way = lambda step: F.when(step["goes_right"], F.get(branches, step["node"])["right"]).otherwise(F.get(branches, step["node"])["left"])
        return F.transform(paths, lambda p: F.aggregate(p, F.lit(0.0), lambda s, step: s + way(step)))

    logs = F.transform(F.transform(z, C.sigmoid), lambda f: F.struct(C.std_log(1 - f).alias("left"), C.std_log(f).alias("right")))
    return C.let(logs, of)


def ranked_labels(scored: DataFrame, m: ModelFrames, k: int, threshold: float) -> DataFrame:
    """scored with ranked: array of (label_id, logp), best first, equal scores by falling label id."""
    least = F.lit(float(threshold))
    if m.loss == 1:
        logp = tree_array(F.col("z"), F.col("paths"))
        fits = (lambda x: F.lit(True)) if threshold <= 0 else (lambda x: F.lit(threshold < 1.0) & (x["logp"] >= C.std_log(least)))
        pairs = F.transform(logp, lambda x, i: F.struct(x.alias("logp"), i.alias("label_id")))
    else:
        fits = lambda x: x["prob"] >= least
        pairs = F.transform(softmax_array(F.col("z")), lambda x, i: F.struct(C.std_log(x).alias("logp"), i.alias("label_id"), x.alias("prob")))
    best = F.slice(F.sort_array(F.transform(F.filter(pairs, fits), lambda x: F.struct(x["logp"].alias("logp"), x["label_id"].alias("label_id"))), asc=False), 1, max(k, 1))
    return scored.withColumn("ranked", best if k > 0 else F.slice(best, 1, 0))


def scores(vectors: DataFrame, m: ModelFrames) -> DataFrame:
    """doc_id, label_id, score: every output row against every text."""
    if m.head is not None:
        return score_array(vectors, m).select("doc_id", F.posexplode("z").alias("label_id", "score")).select("doc_id", F.col("label_id").cast("long").alias("label_id"), "score")
    return vectors.crossJoin(m.output).select("doc_id", "label_id", _score(F.col("vec")).alias("score"))


def softmax(scored: DataFrame) -> DataFrame:
    """doc_id, label_id, prob, shifted by the greatest score."""
    w = Window.partitionBy("doc_id")
    shifted = scored.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    return shifted.select("doc_id", "label_id", (F.col("e") / F.sum("e").over(w)).alias("prob"))


def hierarchical(vectors: DataFrame, m: ModelFrames) -> DataFrame:
    """doc_id, label_id, logp: the sum of branch logarithms along each label's path; one label alone has logp 0."""
    steps = m.hs_path.join(m.output.withColumnRenamed("label_id", "inner_row"), "inner_row")
    f = C.sigmoid(_score(F.col("vec")))
    branch = C.std_log(F.when(F.col("is_right"), f).otherwise(1 - f))
    found = vectors.crossJoin(steps).groupBy("doc_id", "label_id").agg(F.sum(branch).alias("logp"))
    alone = m.labels.select("label_id").join(m.hs_path.select("label_id").distinct(), "label_id", "left_anti")
    return found.union(vectors.select("doc_id").crossJoin(alone).select("doc_id", "label_id", F.lit(0.0).alias("logp")))


def top_k(ranked: DataFrame, k: int) -> DataFrame:
    """doc_id, rank, label_id, logp: equal scores by falling label id."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("logp"), F.desc("label_id"))
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("doc_id", "rank", "label_id", "logp")


def log_probabilities(vectors: DataFrame, m: ModelFrames, threshold: float = 0.0) -> DataFrame:
    """doc_id, label_id, logp of the labels that reach the threshold."""
    if m.loss == 1:
        rows = hierarchical(vectors, m)
        return rows.where(C.std_log(F.lit(float(threshold))) <= F.col("logp")).where(F.lit(threshold < 1.0)) if threshold > 0 else rows
    rows = softmax(scores(vectors, m))
    return rows.where(F.col("prob") >= threshold).select("doc_id", "label_id", C.std_log(F.col("prob")).alias("logp"))


def _labelled(m: ModelFrames) -> None:
    if not m.supervised:
        raise InvalidModelError("only a supervised model has labels")
    if m.loss == 1 and m.hs_path is None:
        raise InvalidModelError("hierarchical softmax needs the label tree")


def _ranked(vectors: DataFrame, m: ModelFrames, k: int, threshold: float) -> DataFrame:
    """vectors with predictions: array of (label, logp)."""
    if m.head is not None:
        rows = ranked_labels(score_array(vectors, m), m, k, threshold)
        return rows.select(*vectors.columns, F.transform("ranked", lambda x: F.struct(F.get("names", x["label_id"]).alias("label"), x["logp"].alias("logp"))).alias("predictions"))
    named = top_k(log_probabilities(vectors.where("n > 0"), m, threshold), k).join(m.labels, "label_id")
    lists = named.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "label", "logp"))).alias("p"))  # k at most
    lists = lists.select("doc_id", F.transform("p", lambda x: F.struct(x["label"].alias("label"), x["logp"].alias("logp"))).alias("predictions"))
    return vectors.join(lists, "doc_id", "left")


def predict_rows(df: DataFrame, m: ModelFrames, k: int = 1, threshold: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rank, label, prob: at most k labels of each text, best first."""
    _labelled(m)
    ranked = _ranked(text_vectors(df, m, id_col, text_col).where("n > 0"), m, k, threshold)
    return ranked.select("doc_id", F.posexplode("predictions").alias("i", "p")).select("doc_id", (F.col("i") + 1).alias("rank"), "p.label", F.exp("p.logp").alias("prob"))


def predict(df: DataFrame, m: ModelFrames, k: int = 1, threshold: float = 0.0, id_col: str = "doc_id", text_col: str = "text", on_empty: str = "status", strip_prefix: bool = False) -> DataFrame:
    """The ids of df with predictions (array of label, probability) and status (OK, EMPTY_INPUT, or null for null texts).

    on_empty="fail" raises on the first text without features.  k = 0 gives empty lists.  A model without labels is an error.
    """
    _labelled(m)
    out = _ranked(text_vectors(df, m, id_col, text_col), m, k, threshold)
    empty = F.lit("EMPTY_INPUT") if on_empty == "status" else F.raise_error(F.lit("EMPTY_INPUT"))
    status = F.when(F.col("n").isNull(), F.lit(None)).when(F.col("n") > 0, F.lit("OK")).otherwise(empty)
    none = F.expr("cast(array() as array<struct<label:string,probability:float>>)")
    name = lambda x: F.regexp_replace(x["label"], "^__label__", "") if strip_prefix else x["label"]
    found = F.transform("predictions", lambda x: F.struct(name(x).alias("label"), F.exp(x["logp"]).cast("float").alias("probability")))
    found = F.when(F.col("n").isNotNull(), F.when(F.col("n") > 0, F.coalesce(found, none)).otherwise(none))
    return out.select(F.col("doc_id").alias(id_col), found.alias("predictions"), status.cast("string").alias("status"))


def sentence_vectors(df: DataFrame, m: ModelFrames, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, vector (array of float): the mean alone, of texts with features."""
    return text_vectors(df, m, id_col, text_col).where("n > 0").select(F.col("doc_id").alias(id_col), F.col("hidden").cast("array<float>").alias("vector"))


def decode_rows(codes: DataFrame, centroids: DataFrame, norms: DataFrame | None = None) -> DataFrame:
    """row_id, vec: product-quantised rows as a join of codes with centroids, times the row norm (1 without norms)."""
    parts = codes.select("row_id", "norm_code", F.posexplode("codes").alias("part", "code"))
    rows = parts.join(F.broadcast(centroids), ["part", "code"]).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("part", "vec"))).alias("p"), F.first("norm_code").alias("norm_code"))
    flat = F.flatten(F.transform("p", lambda x: x["vec"]))
    if norms is None:
        return rows.select("row_id", flat.alias("vec"))
    named = norms.where("part = 0").select(F.col("code").alias("norm_code"), F.get("vec", F.lit(0)).alias("norm"))
    return rows.join(F.broadcast(named), "norm_code", "left").select("row_id", F.transform(flat, lambda x: x * F.coalesce("norm", F.lit(1.0).cast("float"))).alias("vec"))
