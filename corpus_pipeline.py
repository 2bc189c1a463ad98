"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs.  All but the last return the columns of documents.

Common to the stages: columns other than doc_id, text (and n_chars) pass through untouched, whatever their names, for a stage keeps the row in a
struct beside its own columns; empty tables give empty results; rows are independent but in near_duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import decontaminate, dedup, quality, secrets, tokenizers_
from glyphmill.llm.queries import table, vocabulary
from glyphmill.llm.scratch import Scratch

#: Ids that are broadcast at most; beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000
#: Documents are near-duplicates from this Jaccard similarity of their five-word shingles on; op1's query asks for 85.
NEAR_PERCENT = 80
#: Rows of an Arrow batch at most.  By default a task's whole input may be one batch, which executor and Python worker hold several times.
BATCH_ROWS = 500


def _small_batches(spark: SparkSession) -> None:
    """From here on the session's Arrow batches are small (results do not depend on it); a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def _row(docs: DataFrame):
    """The columns of docs as a struct, so that a stage's own columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy rejects go.  The rules read the row itself, so nothing is joined.

    A null or empty text has no words and goes; a very long one is measured whole; repeated rows are judged alike.
    """
    rows = docs.select(_row(docs), F.col("text").alias("_text"))
    kept = quality.apply_policy(quality.ledger(rows, "_row", "_text"), quality.PRODUCTION).where("kept")
    return kept.select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    Documents without an id cannot be told apart and stay; null and empty texts resemble nothing and stay; very long texts are compared whole.  Different texts of one
    id are documents of their own: the one with the least hash has the id, the others come, by hash, after all ids.  Of rows that repeat an id and a text the
    one with the least hash of all its columns stays.
    """
    _small_batches(spark)
    scratch = Scratch(spark, "pipeline-dedup")
    few = lambda df, n: F.broadcast(df) if n <= BROADCAST_IDS else df
    rows = docs.select(_row(docs), F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), F.xxhash64("text", F.col("text").isNull()).alias("_hash"))
    ids = rows.where("_id IS NOT NULL").groupBy("_id").agg(F.min("_hash").alias("_least"), F.max("_hash").alias("_most"), F.count("*").alias("_n")).where("_n > 1")
    ids = scratch.keep("ids", ids)  # few, if any
    several = ids.where("_least <> _most").select("_id", "_least")
    rows = rows.withColumn("_near", F.col("_id"))
    if (n := several.count()) > 0:
        top = rows.agg(F.max("_id")).first()[0]
        more = rows.select("_id", "_hash").join(few(several, n), "_id").where("_hash <> _least").select("_id", "_hash").distinct().orderBy("_id", "_hash")
        more = scratch.keep("more", more.select("_id", "_hash", (F.monotonically_increasing_id() + F.lit(top) + 1).alias("_number")))
        rows = rows.join(few(more, more.count()), ["_id", "_hash"], "left").withColumn("_near", F.coalesce("_number", "_near"))
    found = scratch.keep("found", dedup.near_duplicates(rows, id_col="_near", text_col="_text", percent=NEAR_PERCENT).select(F.col("_near").alias("_found"), "kept"))
    drop = scratch.keep("drop", found.where("NOT kept").select("_found").distinct())
    out = rows.join(few(drop, drop.count()), F.col("_near") == F.col("_found"), "left_anti")
    if ids.isEmpty():
        return out.select("_row.*")
    twice = scratch.keep("twice", found.where("kept AND _found IS NOT NULL").groupBy("_found").count().where("count > 1").select("_found"))
    twice = few(twice, twice.count())
    once = out.join(twice, F.col("_near") == F.col("_found"), "left_anti").select("_row")
    repeated = out.join(twice, F.col("_near") == F.col("_found"), "left_semi")
    return once.union(repeated.groupBy("_near").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row")).select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and empty texts hold none and stay; very long ones are searched whole; repeated rows are judged alike; null or empty items match
    nothing, and without items all documents stay.
    """
    _small_batches(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts become a mark, and n_chars follows the text.

    Null texts stay null; very long ones are scanned whole; repeated rows are treated alike.
    """
    rows = docs.select(_row(docs), F.col("text").alias("_text"))
    found = secrets.find_secrets(rows, "_row", "_text")
    text = F.when(F.col("_row.text").isNotNull(), secrets.redacted(F.col("_text"), F.col("spans"))).alias("_new")
    out = found.select("_row", text)
    changed = F.length("_new").cast("long")
    n_chars = F.when(F.col("_new") != F.col("_row.text"), changed).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None
    own = {"text": F.col("_new"), "n_chars": n_chars}
    return out.select(*[own.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text they decode to.

    A null text counts as empty; very long ones are encoded whole; repeated rows give equal rows.
    """
    _small_batches(spark)
    return tokenizers_.sentencepiece_round_trip(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece", sentencepiece),
]

#: Exact Jaccard components over surviving rows, edit distances and BPE are beyond SQL here; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(name, stage(spark, docs, sf_dir))
    return docs
