"""Text to feature ids, as relations.

Tokens meet the vocabulary by a broadcast of known size, or else by a join that deals out hot tokens.  Unknown tokens are counted per document
first and hashed once per distinct token, in the row.  Word n-grams are hashed in the row of their document: no join at all.
Rows that repeat an id count as one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import columns as C
from glyphmill.operators.skew import spread_join
from glyphmill.sources.frames import BROADCAST_BYTES, ModelFrames
from glyphmill.sources.model_file import EOS, LABEL_PREFIX
from glyphmill.sources.shared import Scratch


def token_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, pos, token; null texts have no rows."""
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), C.tokens(F.col(text_col)).alias("t"))
    return rows.select("doc_id", F.posexplode("t").alias("pos", "token"))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, token, cnt."""
    return token_rows(df, id_col, text_col).groupBy("doc_id", "token").agg(F.count("*").alias("cnt"))


def vocabulary(m: ModelFrames) -> DataFrame:
    """word, id, entry_type: of repeated words the last id counts."""
    return m.dictionary.groupBy("word").agg(F.max(F.struct("id", "entry_type")).alias("e")).select("word", "e.id", "e.entry_type")


def with_table(tokens: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """tokens (doc_id, token, ...) left joined with a table by word; size in bytes, 0 if unknown."""
    if 0 < size <= BROADCAST_BYTES:
        return tokens.join(F.broadcast(table), tokens["token"] == table["word"], "left")
    return spread_join(tokens, ["token"], "doc_id" if "doc_id" in tokens.columns else "token", table.select(F.col("word").alias("token"), "*"), "left")


def lookup(tokens: DataFrame, m: ModelFrames) -> DataFrame:
    """tokens with id (-1 if unknown) and entry_type (0 word, 1 label; unknown ones by their prefix)."""
    known = with_table(tokens, vocabulary(m), m.dictionary_bytes)
    kind = F.coalesce("entry_type", F.when(F.startswith("token", F.lit(LABEL_PREFIX)), 1).otherwise(0))
    return known.select(*tokens.columns, F.coalesce("id", F.lit(-1)).cast("long").alias("id"), kind.cast("int").alias("entry_type"))


def remap(hashes: DataFrame, m: ModelFrames, column: str = "h") -> DataFrame:
    """row_id for bucket numbers in column; three plans, chosen by the model's prune size."""
    others = [c for c in hashes.columns if c != column]
    if m.prune_size < 0:
        return hashes.select(*others, (F.col(column) + m.nwords).alias("row_id"))
    if m.prune_size == 0:
        return hashes.where(F.lit(False)).select(*others, F.col(column).alias("row_id"))
    table = F.broadcast(m.prune) if m.prune_size * 16 <= BROADCAST_BYTES else m.prune
    return hashes.join(table, hashes[column] == F.col("hash_id")).select(*others, (F.col("remapped") + m.nwords).alias("row_id"))


def subword_ids(tokens: DataFrame, m: ModelFrames) -> DataFrame:
    """token, row_id: the subwords of distinct tokens, repeated ones repeatedly.  The end token has none."""
    buckets = C.subword_buckets(F.col("token"), m.minn, m.maxn, m.bucket)
    return remap(tokens.where(F.col("token") != EOS).select("token", F.explode(buckets).alias("h")), m)


def token_ids(tokens: DataFrame, m: ModelFrames) -> DataFrame:
    """token, row_id of distinct tokens: a word's own row, and its subwords."""
    distinct = lookup(tokens.select("token"), m).where("entry_type = 0")
    ids = distinct.where("id >= 0").select("token", F.col("id").alias("row_id"))
    return ids.union(subword_ids(distinct.select("token"), m).select("token", "row_id")) if m.maxn > 0 else ids


def word_ids(m: ModelFrames) -> DataFrame:
    """word, row_id of the vocabulary's words: what a model prepares once."""
    words = vocabulary(m).where("entry_type = 0")
    ids = words.select("word", F.col("id").alias("row_id"))
    return ids.union(subword_ids(words.select(F.col("word").alias("token")), m).select(F.col("token").alias("word"), "row_id")) if m.maxn > 0 else ids


def is_word(token: Column, m: ModelFrames) -> Column:
    """Not a label: by prefix, but for the vocabulary's entries whose type and prefix disagree."""
    plain = ~F.startswith(token, F.lit(LABEL_PREFIX))
    return plain != token.isin(list(m.odd_words)) if m.odd_words else plain


def unknown_tokens(rows: DataFrame, m: ModelFrames, size: int, words: DataFrame) -> DataFrame:
    """doc_id, token, cnt of tokens that are no entry of the vocabulary, no label and not the end token."""
    odd = with_table(rows, words, size).where(F.col("word").isNull() & (F.col("token") != EOS) & ~F.startswith("token", F.lit(LABEL_PREFIX)))
    return odd.groupBy("doc_id", "token").agg(F.count("*").alias("cnt"))


def word_features(rows: DataFrame, m: ModelFrames) -> DataFrame:
    """doc_id, row_id, cnt of whole words and subwords of rows (doc_id, token)."""
    size = m.dictionary_bytes
    own = vocabulary(m)
    known = with_table(rows, word_ids(m).groupBy("word").agg(F.collect_list("row_id").alias("ids")), size).where("word IS NOT NULL")  # ids: of one word
    out = known.select("doc_id", F.explode("ids").alias("row_id")).groupBy("doc_id", "row_id").agg(F.count("*").alias("cnt"))
    if m.maxn <= 0:
        return out
    odd = Scratch(rows.sparkSession, "unknown").keep("tokens", unknown_tokens(rows, m, size, own.select("word")))  # read more than once
    ids = subword_ids(odd.select("token").distinct(), m).groupBy("token").agg(F.collect_list("row_id").alias("ids"))  # of one token
    more = spread_join(odd, ["token"], "doc_id", ids).select("doc_id", "cnt", F.explode("ids").alias("row_id"))
    return out.unionByName(more.select("doc_id", "row_id", "cnt")).groupBy("doc_id", "row_id").agg(F.sum("cnt").alias("cnt"))


def word_ngram_buckets(df: DataFrame, m: ModelFrames, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h: a row per word n-gram of 2 .. word_ngrams consecutive non-label tokens, end token included."""
    words = F.filter(C.tokens(F.col(text_col)), lambda t: is_word(t, m))
    hashes = F.transform(words, C.fnv1a)
    return df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode(C.word_ngram_buckets(hashes, m.word_ngrams, m.bucket)).alias("h"))


def features(df: DataFrame, m: ModelFrames, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_id, cnt: the multiset of input rows of every text."""
    out = word_features(token_rows(df, id_col, text_col).select("doc_id", "token"), m)
    if m.word_ngrams > 1:
        grams = remap(word_ngram_buckets(df, m, id_col, text_col), m).groupBy("doc_id", "row_id").agg(F.count("*").alias("cnt"))
        out = out.union(grams).groupBy("doc_id", "row_id").agg(F.sum("cnt").alias("cnt"))
    return out


def line_labels(df: DataFrame, m: ModelFrames, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, label_id, cnt of the known labels written in the texts."""
    found = lookup(token_rows(df, id_col, text_col).select("doc_id", "token"), m).where("id >= 0 AND entry_type = 1")
    return found.groupBy("doc_id", (F.col("id") - m.nwords).alias("label_id")).agg(F.count("*").alias("cnt"))
