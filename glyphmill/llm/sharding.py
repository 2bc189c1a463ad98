"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair has a hash u in (0, 1]; a row goes to the shard with the largest -weight / ln(u).  Adding a
shard moves only the rows that it wins, weight / total of them, and all of them into the new shard.

Slots number the rows of a shard from 0 without a gap.  No task ever holds a whole shard: rows are numbered inside
(shard, bucket) by the key's hash, and each bucket starts where the counts of the lower ones end.  Only ids, sizes and checksums
are shuffled, never texts.

A null key hashes as its own value, apart from all others; a null text has size 8 and the checksum of no bytes.
Repeated rows share a shard and get different slots; an empty table gives an empty result; of very long texts only sizes and checksums are kept.  Columns other than key and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest that are used: 52 bits, exact in a double.
DIGITS = 13


def unit_hash(key: Column, salt: str) -> Column:
    """(0, 1]: the first 52 bits of md5 over key and salt, plus one, as a fraction."""
    digest = F.substring(F.md5(F.concat(key, F.lit("/" + salt))), 1, DIGITS)
    return (F.conv(digest, 16, 10).cast("long") + 1).cast("double") / F.lit(float(16**DIGITS))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The winning shard.  With equal weights the order of -w / ln(u) is that of u, so no logarithm is taken."""
    if not weights or any(not w > 0 or math.isinf(w) for w in weights):
        raise ValueError("weights must be positive and finite")
    equal = len(set(weights)) == 1
    scores = []
    for shard, w in enumerate(weights):
        u = unit_hash(key, str(shard))
        score = u if equal else F.when(u == 1.0, F.lit(math.inf)).otherwise(-F.lit(float(w)) / F.log(u))
        scores.append(F.struct(score.alias("score"), F.lit(-shard).alias("shard")))
    return -(F.greatest(*scores)["shard"] if len(scores) > 1 else F.lit(0))


def shard_rows(
    df: DataFrame,
    shards: int = 24,
    weights: list[float] | None = None,
    grow_by: float | None = 1.0,
    key_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 4096,
) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard.

    grow_by is the weight of one more shard (null: no grown_shard).  buckets bounds the rows a task numbers at once to
    about rows / (shards * buckets); raise it with the input.
    """
    weights = weights or [1.0] * shards
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = df.select(
        F.col(key_col).alias(key_col),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.col(key_col).cast("string"), F.lit("null")).alias("_key"),
    )
    grown = rendezvous(F.col("_key"), [*weights, grow_by]) if grow_by else F.lit(None)
    order = F.md5(F.concat(F.col("_key"), F.lit("/slot")))
    rows = rows.select(
        key_col, "size", "text_crc32",
        rendezvous(F.col("_key"), weights).cast("int").alias("shard"),
        grown.cast("int").alias("grown_shard"),
        order.alias("_order"),
        F.pmod(F.conv(F.substring(order, 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int").alias("_bucket"),
    )
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))  # at most shards * buckets rows
    lower = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_order", key_col, "size", "text_crc32")
    numbered = rows.withColumn("_row", F.row_number().over(inside))
    if len(weights) * buckets * 64 <= 64 << 20:
        starts = F.broadcast(starts)
    joined = numbered.join(starts, (F.col("shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return joined.select(
        key_col, "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_start") + F.col("_row") - 1).cast("long").alias("slot"), "grown_shard",
    )
